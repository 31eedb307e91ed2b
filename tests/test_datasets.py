"""Cards, and gold by name, folder, file and card."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.sources import datasets, files

GOLD = {"doc_id": "d1", "text": "Acme met Bob", "entities": [{"id": "g0", "name": "Acme", "type": "company", "aliases": [], "mentions": []}], "relations": []}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "a.yaml").write_text("name: alpha\nloader: conll\ntype_map: {ORG: company, LOC: null}\nhas_coref: false\n", encoding="utf-8")
    (tmp_path / "cards" / "b.yml").write_text("name: beta\nloader: native\nexhaustive_entity_types: []\n", encoding="utf-8")
    (tmp_path / "cards" / "z.yaml").write_text("name: alpha\nloader: conll\ntype_map: {ORG: company}\noptions: {sentences_per_doc: 1}\n", encoding="utf-8")
    (tmp_path / "cards" / "note.txt").write_text("no card", encoding="utf-8")
    return f"file://{tmp_path}"


def test_catalogue(spark, root):
    rows = {r.name: r for r in datasets.catalogue(datasets.card_files(spark, root)).collect()}
    assert set(rows) == {"alpha", "beta"} and rows["alpha"].path.endswith("z.yaml")  # of equal names the last path
    assert rows["beta"].coverage.exhaustive_entity_types == [] and rows["alpha"].coverage.exhaustive_entity_types is None
    assert rows["beta"].coverage.has_coref and rows["beta"].coverage.exhaustive_relations
    with pytest.raises(KeyError, match="unknown dataset"):
        datasets.card(spark, "gamma", root)
    assert datasets.card(spark, f"{root}/cards/a.yaml", root)["has_coref"] is False


def test_what_is_no_card_fails(spark):
    rows = spark.createDataFrame([("x.yaml", "- a list")], "path string, text string")
    with pytest.raises(PySparkException, match="isn't a card"):
        datasets.catalogue(rows).collect()
    assert datasets.catalogue(rows.where("false")).count() == 0


def test_gold_by_card(spark, root, tmp_path):
    (tmp_path / "raw.txt").write_text("Acme B-ORG\n\nRome B-LOC\n", encoding="utf-8")
    gold, name = datasets.resolve_gold(spark, f"{root}/raw.txt", root, card_spec="alpha")
    rows = gold.orderBy("doc_id").collect()
    assert name == "alpha" and [[e.type for e in r.entities] for r in rows] == [["company"], []] and rows[0].coverage.has_types


def test_prepared_by_name_folder_and_file(spark, root, tmp_path):
    gold = spark.createDataFrame([(json.dumps(GOLD),)], "v string").select(F.from_json("v", "doc_id string, text string, entities array<struct<id:string,name:string,type:string>>, relations array<struct<source:string>>").alias("g")).select("g.*")
    files.write_prepared(gold, f"{root}/sets/prepared", {"name": "sets"})
    (tmp_path / "sets" / "prepared" / "gold.jsonl").write_text(json.dumps(GOLD) + "\n", encoding="utf-8")
    for spec, want in (("sets", "sets"), (f"{root}/sets/prepared", "prepared"), (f"{root}/sets/prepared/gold.jsonl", "sets")):
        rows, name = datasets.resolve_gold(spark, spec, root)
        assert [r.doc_id for r in rows.collect()] == ["d1"] and name == want
    with pytest.raises(FileNotFoundError, match="nothing"):
        datasets.prepared(spark, "nothing", root)


def test_old_format(spark, root, tmp_path):
    (tmp_path / "case.gt.json").write_text(json.dumps({"entities": [{"entity_name": "Acme", "entity_type": "organization"}], "relationships": []}), encoding="utf-8")
    gold, name = datasets.resolve_gold(spark, f"{root}/case.gt.json", root)
    row = gold.first()
    assert name == "case" and row.doc_id == "case" and row.coverage.has_coref is False and row.coverage.has_types
