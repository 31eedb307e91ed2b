"""Read views over stored runs: what a serving layer shows, as DataFrames and temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import graph


def entities(runs: DataFrame) -> DataFrame:
    """One row an entity, types in lower case, blank aliases dropped."""
    e = runs.select("run_id", F.posexplode("entities").alias("pos", "e")).select("run_id", "pos", "e.*")
    kind = F.regexp_replace(F.lower("entity_type"), "^otherentity$", "other")
    aliases = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return e.withColumn("entity_type", kind).withColumn("aliases", aliases)


def relationships(runs: DataFrame) -> DataFrame:
    r = runs.select("run_id", F.posexplode("relationships").alias("pos", "r"))
    return r.select("run_id", "pos", F.col("r.source_entity_id").alias("source"), F.col("r.relationship_type").alias("relation"), F.col("r.target_entity_id").alias("target"), F.col("r.citation").alias("citation"))


def run_graph(runs: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one run."""
    one = runs.where(F.col("run_id") == run_id)
    ents = entities(one)
    return ents.select("entity_id", "canonical_name", "entity_type"), graph.build(ents, relationships(one))


def export(runs: DataFrame, run_id: str, path: str) -> None:
    """The sheets of one run."""
    one = runs.where(F.col("run_id") == run_id)
    ents = entities(one)
    edges = graph.build(ents, relationships(one))
    files.write_sheets({"cover": graph.cover(ents, edges), "register": graph.register(ents, edges), "relationships": graph.relationship_sheet(edges, ents), "evidence": graph.evidence_sheet(ents)}, path)


def create_views(spark: SparkSession, path: str) -> None:
    """Temporary views runs, run_entities and run_relationships over a folder of runs."""
    runs = files.read_runs(spark, path)
    runs.createOrReplaceTempView("runs")
    entities(runs).createOrReplaceTempView("run_entities")
    relationships(runs).createOrReplaceTempView("run_relationships")
