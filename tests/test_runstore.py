"""Artifacts, predictions of runs, exports, listings and telemetry on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from factloom.sources import files, runstore

RUN = (
    "run_id string, created_at string, source_file string, seed int, chunks array<string>, validated_entities array<struct<name:string>>,"
    " entities array<struct<entity_id:string,citations:array<struct<chunk_id:int>>>>, relationships array<struct<source_entity_id:string>>"
)


def _run(run_id, at, entities):
    return (run_id, at, f"{run_id}.txt", 42, ["one", "two"], [("v",)], entities, [])


def test_artifacts_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    cited = [("E1", [(1,), (0,), (1,)]), ("E2", [(1,), (None,)]), ("E3", None)]
    first = spark.createDataFrame([_run("a", "2024-01-01", [("old", [(0,)])]), _run("b", "2024-01-03", None), _run("c", "2024-01-03", [])], RUN)
    for rows in (first, spark.createDataFrame([_run("a", "2024-01-02", cited)], RUN)):
        for save in (runstore.save_manifests, runstore.save_chunks, runstore.save_entities, runstore.save_outputs):
            save(rows, path)
    row = runstore.load_artifact(spark, path, "entities", "a").first()
    assert row.chunk_entity_index == {"0": ["E1"], "1": ["E1", "E1", "E2"]} and [e.entity_id for e in row.canonical_entities] == ["E1", "E2", "E3"]
    assert [runstore.load_artifact(spark, path, name).count() for name in ("manifest", "chunks", "entities", "output")] == [3] * 4 and runstore.latest_run(spark, path) == "c"
    assert runstore.load_artifact(spark, path, "manifest", "a").first().asDict() == {"run_id": "a", "created_at": "2024-01-02", "source_file": "a.txt", "seed": 42, "chunk_max_chars": 2000, "chunk_overlap_chars": 200}
    assert runstore.load_artifact(spark, path, "chunks", "b").first().chunks == ["one", "two"]
    with pytest.raises(FileNotFoundError, match="nope"):
        runstore.load_artifact(spark, path, "output", "nope")
    with pytest.raises(ValueError, match="no committed table"):
        runstore.latest_run(spark, path + "-none")


def test_predictions_of_run_folders(spark, tmp_path):
    for run, body in (("r1", {"entities": [{"id": "[E1]", "name": "Acme", "aliases": ["", None, "Acme", "AC"]}], "relations": [{"source": "E1", "target": "E2", "type": "Part Of"}]}), ("r2", {"entities": []})):
        (tmp_path / run).mkdir()
        (tmp_path / run / "output.json").write_text(json.dumps(body), encoding="utf-8")
    (tmp_path / "r3").mkdir()
    (tmp_path / "r1" / "ops.json").write_text(json.dumps({"run_id": "r1", "status": "completed", "llm": {"cost_usd": 0.5}}), encoding="utf-8")
    path = f"file://{tmp_path}"
    ents, rels, runs = runstore.predictions(spark, path)
    assert [(r.doc_id, r.id, r.name, r.aliases) for r in ents.collect()] == [("r1", "E1", "Acme", ["AC"])]
    assert [(r.source, r.relation, r.target) for r in rels.collect()] == [("E1", "part_of", "E2")]
    assert {r.run_id: r.status for r in runs.collect()} == {"r1": "completed", "r2": None}
    wanted = spark.createDataFrame([("r1",), ("r1",)], "run_id string")
    assert runstore.predictions(spark, path, wanted=wanted)[2].count() == 1
    with pytest.raises(PySparkException, match="did not complete: r3"):
        runstore.predictions(spark, path, wanted=spark.createDataFrame([("r3",)], "run_id string"))[0].collect()


def test_export_again_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("d1", "m", "o1", "log"), ("d2", "m", None, "log")], "run_id string, manifest string, output string, log string")
    runstore.export(rows, "e", path)
    runstore.export(rows.selectExpr("run_id", "manifest", "'o2' AS output"), "e", path)
    got = files.read_keyed(spark, path)
    assert {(r.run_id, r.output) for r in got.collect()} == {("e__d1", "o2"), ("e__d2", "o2")} and "log" not in got.columns


def test_run_map_names_finished_runs(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "runs/d1", True), ("d2", "runs/d2", False), ("d3", "runs/d3", None)], "doc_id string, run string, has_output boolean")
    runstore.write_run_map(rows, f"file://{tmp_path}/map")
    assert [r.doc_id for r in runstore.read_run_map(spark, f"file://{tmp_path}/map").collect()] == ["d1"]


def test_pages_newest_first_cover_all(spark):
    rows = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate([3, 1, 3, None, 2, None, 3])], "run_id string, at int")
    seen, after = [], None
    while page := runstore.newest_first(rows, "at", "run_id", after, 2).collect():
        seen += [r.run_id for r in page]
        after = (page[-1].at, page[-1].run_id)
    assert seen == ["r0", "r2", "r6", "r4", "r1", "r3", "r5"]
    assert [r.run_id for r in runstore.newest_first(rows, "at", "run_id").collect()] == ["r0", "r2", "r6", "r4", "r1", "r3", "r5"]


def test_engine_stats_of_files(spark, tmp_path):
    for run in ("a", "b", "c"):
        (tmp_path / "ev" / run / "x" / "graph").mkdir(parents=True)
    meta = {"pipeline_version": "1", "results": {"nodes": 3, "edges": 2, "dense": {"dropped_chunk_ids": [4, 5], "skeleton_path_counts": {"": 2, "p": 1}}}, "config": {"provenance": True, "secret": "s", "parallel_workers": 4}}
    (tmp_path / "ev" / "a" / "x" / "metadata.json").write_text(json.dumps(meta), encoding="utf-8")
    (tmp_path / "ev" / "b" / "x" / "metadata.json").write_text(json.dumps({"results": {}}), encoding="utf-8")
    span = {"kind": "verbatim", "span": [0, 4]}
    prov = {"nodes": {"n1": {"node_type": "Company", "anchors": [{"kind": "fuzzy"}, span]}, "n2": {"node_type": None, "anchors": []}, "n3": {"node_type": "Company", "anchors": [{"kind": "verbatim", "span": None}]}, "d": {"node_type": "OntologyDocument", "anchors": [span]}}, "chunks": {"0": {"chunk_id": 0, "token_count": 7}, "1": {"chunk_id": 1}}}
    (tmp_path / "ev" / "a" / "x" / "graph" / "provenance.json").write_text(json.dumps(prov), encoding="utf-8")
    rows = {r.run_id: r for r in runstore.engine_stats(spark, f"file://{tmp_path}/ev").collect()}
    a, b = rows["a"], rows["b"]
    assert set(rows) == {"a", "b"} and (a.dropped_chunks, a.skeleton_by_path, a.config) == (2, {"(root)": 2, "p": 1}, {"provenance": "true", "parallel_workers": "4"})
    assert (a.provenance_nodes, a.provenance_verbatim_nodes, a.chunks, a.chunk_tokens) == (3, 1, 2, 7)
    assert b.dropped_chunks == 0 and b.provenance_nodes is None and b.skeleton_by_path == {}
