"""Dataset cards and gold by name, folder or file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import loaders

CARD = "name string, loader string, path string, coverage struct<exhaustive_entity_types:array<string>,exhaustive_relations:boolean,relation_types:array<string>,has_coref:boolean,has_types:boolean>, card string"
_COVERAGE = {"exhaustive_entity_types": None, "exhaustive_relations": True, "relation_types": None, "has_coref": True, "has_types": True}


def coverage(card: dict) -> dict:
    """What a card says its labels cover; what it leaves out is covered."""
    return {k: card.get(k, default) for k, default in _COVERAGE.items()}


def card_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .yaml and .yml files below a folder."""
    raw = spark.read.option("pathGlobFilter", "*.{yaml,yml}").option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def catalogue(rows: DataFrame) -> DataFrame:
    """(path, text) of card files to (name, loader, path, coverage, card as JSON); of equal names the last path stays.

    A file that isn't a mapping with a name is no card; it fails the job, as does YAML that can't be read.
    """

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                card = yaml.safe_load(text)
                if not isinstance(card, dict) or not card.get("name"):
                    raise ValueError(f"{path} isn't a card: it has no name")
                rows.append((str(card["name"]), card.get("loader"), path, coverage(card), json.dumps(card, ensure_ascii=False, sort_keys=True, default=str)))
            yield pd.DataFrame(rows, columns=["name", "loader", "path", "coverage", "card"])

    return rows.select("path", "text").mapInPandas(parsed, CARD).groupBy("name").agg(F.max_by(F.struct("loader", "path", "coverage", "card"), "path").alias("c")).select("name", "c.*")


def card(spark: SparkSession, name_or_path: str, root: str) -> dict:
    """One card: a .yaml or .yml file, else a name of the catalogue below ``root``; an unknown name is a KeyError."""
    if name_or_path.endswith((".yaml", ".yml")):
        found = catalogue(card_files(spark, name_or_path)).select("card").first()
    else:
        found = catalogue(card_files(spark, root)).where(F.col("name") == name_or_path).select("card").first()
    if found is None:
        raise KeyError(f"unknown dataset {name_or_path!r}")
    return json.loads(found[0])


def from_card(spark: SparkSession, card: dict, path: str) -> DataFrame:
    """Gold documents of a raw file as its card says, each with the card's coverage."""
    options = {**(card.get("options") or {}), "name": card["name"], "type_map": card.get("type_map"), "relation_map": card.get("relation_map")}
    return loaders.load(spark, card["loader"], path, {k: v for k, v in options.items() if v is not None}, coverage(card))


def _native(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return loaders.load(spark, "native", path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def prepared(spark: SparkSession, spec: str, root: str) -> DataFrame:
    """Gold of a .jsonl file, else of a prepared folder, else of the dataset of that name below ``root``; FileNotFoundError if there is none."""
    paths = [spec] if spec.endswith(".jsonl") else [f"{spec.rstrip('/')}/gold"] if "/" in spec else []
    for path in [*paths, f"{root}/{spec}/prepared/gold"]:
        rows = _native(spark, path)
        if rows is not None:
            return rows
    raise FileNotFoundError(f"no prepared gold for {spec!r} below {root}")


def resolve_gold(spark: SparkSession, spec: str, root: str, card_spec: str | None = None, gold_path: str | None = None) -> tuple[DataFrame, str]:
    """(gold, dataset name): a raw file read as a card says, a .gt.json file of the old format, or prepared gold."""
    if card_spec:
        found = card(spark, card_spec, root)
        return from_card(spark, found, gold_path or spec), found["name"]
    parts = spec.rstrip("/").split("/")
    if spec.endswith(".gt.json"):
        name = parts[-1].removesuffix(".gt.json")
        return from_card(spark, {"name": name, "loader": "legacy", "has_coref": False}, spec), name
    return prepared(spark, spec, root), parts[-3] if spec.endswith(".jsonl") and len(parts) > 2 else parts[-1]
