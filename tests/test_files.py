"""Sources, sinks, the converter, views, loaders and streaming on small files."""

from __future__ import annotations

import json

import pytest

from factloom import schema as S
from factloom.operators import convert, passes, views
from factloom.sources import files, loaders
from factloom.streaming import ingest

TEXT = "Dana Cole represents Acme Corp under the Master Agreement. Later Acme Corp paid."


def url(path) -> str:
    return f"file://{path}"


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny", encoding="utf-8")
    (tmp_path / "b.md").write_text("no", encoding="utf-8")
    assert [r.text for r in files.read_text(spark, url(tmp_path)).collect()] == ["x\ny"]
    with pytest.raises(NotImplementedError):
        files.read_text(spark, "x.pdf")
    with pytest.raises(ValueError, match="docx"):
        files.read_text(spark, "x.docx")


def test_uploads(spark, tmp_path):
    (tmp_path / "0a1b2c3d_my_file.txt").write_text("hello", encoding="utf-8")
    row = files.uploads(spark, url(tmp_path)).first()
    assert (row.upload_id, row.filename, row.size_bytes) == ("0a1b2c3d", "my_file.txt", 5)
    shown = spark.createDataFrame([("a.txt", "t"), ("a.PDF", None), ("a.doc", "t")], "stored_filename string, text string")
    assert [r.view is not None for r in files.upload_view(shown).collect()] == [True, True, False]


@pytest.fixture
def run_folder(tmp_path):
    out = {
        "entities": [
            {"entity_id": "E1", "canonical_name": "Acme Corp", "entity_type": "Company", "aliases": [None, "", "Acme"], "citations": [{"file_id": "f", "chunk_id": 0, "start_char": 0, "end_char": 4, "quote": "Acme", "match": "verbatim"}]},
            {"entity_id": "E2", "canonical_name": "Bolt LLC", "entity_type": "OtherEntity", "aliases": [], "citations": []},
        ],
        "relationships": [{"source_entity_id": "[E1]", "target_entity_id": "E2", "relationship_type": "controls", "citation": {"quote": "q"}}],
    }
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r2").mkdir()
    (tmp_path / "runs" / "r1" / "output.json").write_text(json.dumps(out), encoding="utf-8")
    (tmp_path / "runs" / "r2" / "ops.json").write_text(json.dumps({"run_id": "r2", "status": "failed", "error": "boom", "llm": {"cost_usd": 0.5, "by_model": {"m": {"calls": 2}}}, "stages_s": {"a": 1.5}}), encoding="utf-8")
    return url(tmp_path / "runs")


def test_runs_views_and_export(spark, run_folder, tmp_path):
    runs = files.read_runs(spark, run_folder)
    assert [r.run_id for r in runs.collect()] == ["r1"]
    ents = {r.entity_id: (r.entity_type, r.aliases) for r in views.entities(runs).collect()}
    assert ents == {"E1": ("company", ["Acme"]), "E2": ("other", [])}
    nodes, edges = views.run_graph(runs, "r1")
    assert nodes.count() == 2 and [(r.source, r.target) for r in edges.collect()] == [("E1", "E2")]
    assert {r.problem for r in files.audit_runs(runs).collect()} == {"alias isn't text"}
    ops = files.read_ops(spark, run_folder).first()
    assert (ops.status, ops.error, ops.llm.cost_usd, ops.stages_s["a"]) == ("failed", "boom", 0.5, 1.5)
    views.export(runs, "r1", url(tmp_path / "sheets"))
    reg = {r.canonical_name: r for r in spark.read.csv(url(tmp_path / "sheets/register"), header=True).collect()}
    assert reg["Acme Corp"].first_quote == "Acme" and reg["Bolt LLC"].mentions == "0"
    views.create_views(spark, run_folder)
    assert spark.sql("select count(*) from run_entities e join run_relationships r on e.run_id = r.run_id").first()[0] == 2


def test_converter(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text(
        'id,label,type,__class__,name,document_name,entity_type,__provenance__\n'
        'OntologyDocument_1,OntologyDocument,node,OntologyDocument,,doc,,\n'
        'P1,Person,node,Person,Dana Cole,,person,"{""match"":""verbatim"",""chunks"":[0]}"\n'
        'C1,Company,node,Company,Acme Corp,,company,\n'
        'A1,Agreement,node,Agreement,Master Agreement,,,\n'
        'X1,Asset,node,Asset,Ghost Tower,,asset,\n', encoding="utf-8")  # fmt: skip
    (tmp_path / "edges.csv").write_text("source,target,label\nOntologyDocument_1,P1,MENTIONS_PERSON\nP1,C1,REPRESENTS\nC1,A1,PARTICIPATES_IN\nC1,nobody,CONTROLS\n", encoding="utf-8")
    prov = {"version": 1, "chunks": {"0": {"chunk_id": 0, "text": TEXT}}, "nodes": {"Person|Dana": {"node_type": "Person", "ids": {"name": "Dana Cole"}, "anchors": [{"chunk_id": 0, "kind": "verbatim", "span": [0, 9]}, {"chunk_id": 0, "kind": "verbatim", "span": [0, 9]}, {"chunk_id": 0, "kind": "fuzzy", "span": [1, 3]}]}}}
    (tmp_path / "p.json").write_text(json.dumps(prov), encoding="utf-8")
    nodes, edges = files.graph_nodes(spark, url(tmp_path / "nodes.csv")), files.graph_edges(spark, url(tmp_path / "edges.csv"))
    assert nodes.where("id = 'P1'").first().provenance.match == "verbatim" and nodes.where("id = 'C1'").first().provenance.match is None
    anchors, chunks = files.provenance(spark, url(tmp_path / "p.json"))
    ents, rels = convert.convert(nodes, edges, anchors, chunks, spark.createDataFrame([(TEXT,)], "text string"))
    got = {r.entity_id: [(c.start_char, c.end_char, c.quote, c.match) for c in r.citations] for r in ents.collect()}
    assert got["P1"] == [(0, 9, "Dana Cole", "verbatim")] and [c[3] for c in got["C1"]] == ["name_search"] * 2 and got["X1"] == [(0, 0, "", "unanchored")] and set(got) == {"P1", "C1", "A1", "X1"}
    assert all(TEXT[a:b] == q for cs in got.values() for a, b, q, _ in cs if b)
    assert {(r.source, r.relation, r.target) for r in rels.collect()} == {("P1", "represents", "C1"), ("C1", "participates_in", "A1")}


def test_prepared_history_scores(spark, tmp_path):
    gold = spark.createDataFrame([("d", "t", [], [])], S.GOLD.split(", coverage")[0])
    files.write_prepared(gold, url(tmp_path / "prep"), {"name": "x"})
    assert loaders.load(spark, "native", url(tmp_path / "prep/gold")).first().doc_id == "d"
    rows = spark.createDataFrame([("e1", 0.5, 1)], "eval_id string, entity_recall double, junk int")
    for _ in range(2):
        files.append_history(rows, url(tmp_path / "history"))
    back = files.read_history(spark, url(tmp_path / "history"))
    assert back.columns == files.HISTORY and [(r.eval_id, r.entity_recall, r.cost_usd) for r in back.collect()] == [("e1", "0.5", None)] * 2
    for value in (1.0, 2.0):
        files.append_scores(spark.createDataFrame([("r:m", "m", value), (f"r:{value}", "n", 1.0)], "score_id string, metric string, value double"), url(tmp_path / "scores"))
    assert {r.score_id: r.value for r in spark.read.parquet(url(tmp_path / "scores")).collect()} == {"r:m": 2.0, "r:1.0": 1.0, "r:2.0": 1.0}
    assert "| x | n/a |" in files.render_report({"x": None, "y": 0.5}) and len(files.HISTORY) == 28


def test_cards_and_registry(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: alpha\nloader: conll\n", encoding="utf-8")
    assert loaders.cards(str(tmp_path))["alpha"]["loader"] == "conll"
    with pytest.raises(KeyError, match="unknown loader"):
        loaders.load(spark, "nope", "x")
    assert set(loaders.LOADERS) == {"native", "conll", "docred", "squad", "textract", "legacy"}


def test_conll_without_markers_is_cut_by_sentences(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(f"Tok{i} B-PER\n" for i in range(5)), encoding="utf-8")
    rows = loaders.load(spark, "conll", url(tmp_path / "x.txt"), {"sentences_per_doc": 2}, {"has_coref": False}).orderBy("doc_id").collect()
    assert [len(r.entities) for r in rows] == [2, 2, 1] and rows[0].text == "Tok0\nTok1\n" and rows[0].coverage.has_coref is False


def test_legacy_duplicates_and_implied_ends(spark, tmp_path):
    gt = {"entities": [{"entity_name": "Acme", "entity_type": "organization"}, {"entity_name": "ACME.", "entity_type": "person"}], "relationships": [{"source": "Acme", "relationship": "controls", "target": "Nobody"}]}
    (tmp_path / "z.gt.json").write_text(json.dumps(gt), encoding="utf-8")
    row = loaders.load(spark, "legacy", url(tmp_path / "z.gt.json")).first()
    assert row.doc_id == "z" and {(e.id, e.type) for e in row.entities} == {("g0", "company"), ("g1", "person"), ("implied-nobody", "other")}
    assert (row.relations[0].source, row.relations[0].target) == ("g1", "implied-nobody")


def test_best_text(spark):
    texts = spark.createDataFrame([("d", "a", "Acme"), ("d", "b", "Acme and Bolt"), ("d", "c", "Acme and Bolt")], "doc_id string, path string, text string")
    names = spark.createDataFrame([("d", "Acme"), ("d", "Bolt")], "doc_id string, name string")
    assert loaders.best_text(texts, names).first().path == "b"


def test_messy_prediction(spark):
    raw = spark.createDataFrame([("d", json.dumps({"entities": [{"entity_id": "[E1]", "canonical_name": "Acme Corp", "entity_type": "Company", "aliases": [None, ""], "citations": [{"quote": "only"}]}], "relations": [{"source": "E1", "target": "E2", "type": "Owned By"}]}))], "doc_id string, json string")
    e = loaders.prediction_entities(raw).first()
    assert (e.id, e.type, e.aliases, e.quotes, e.spans) == ("E1", "company", [], ["only"], [])
    assert loaders.prediction_relations(raw).first().relation == "owned_by"


def test_extractors(spark):
    chunks = spark.createDataFrame([("d", 0, "then Acme Corp met Dana Cole"), ("d", 1, "nothing here")], "doc_id string, chunk_id int, text string")
    assert {r.entity_name for r in passes.RuleExtractor().proposals(chunks).collect()} == {"Acme Corp", "Dana Cole"}
    stored = spark.createDataFrame([("d", 0, "x"), ("e", 0, "y")], "doc_id string, chunk_id int, entity_name string")
    assert passes.Replay(stored).proposals(chunks).count() == 1

    def fails(frame):
        raise RuntimeError("offline")

    assert passes.Callback(fails, "doc_id string").proposals(chunks).count() == 0
    few = passes.present(chunks, spark.createDataFrame([("d", "E1", "Acme Corp", []), ("d", "E2", "Cole", ["Dana Cole"])], "doc_id string, entity_id string, canonical_name string, aliases array<string>"), least=2)
    assert {r.chunk_id for r in few.collect()} == {0}


def test_stream_ingest(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    args = (spark, url(land), url(tmp_path / "out"), url(tmp_path / "cp"))
    ingest.stream_chunks(*args).awaitTermination()
    (land / "b.txt").write_text("three", encoding="utf-8")
    ingest.stream_chunks(*args).awaitTermination()
    rows = spark.read.parquet(url(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [("a.txt", "one\ntwo"), ("b.txt", "three")]


def test_content_lock(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert files.content_lock(spark, url(tmp_path)).first().sha256.startswith("ba7816bf")


def test_a_ledger_query_does_not_make_a_file_a_run(spark, monkeypatch):
    from factloom.plans import file_queries

    monkeypatch.setattr(file_queries.files, "write_ops", lambda *a: 1 / 0)
    assert file_queries.k07(spark, "/root/testdata/sf0.001").columns == ["run_id", "status", "cost_usd", "error"]
