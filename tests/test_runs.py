"""Whole runs and replays on a document worked out by hand."""

from __future__ import annotations

import hashlib

import pytest

from factloom.operators import chunk, convert, runs

TEXT = 'Aurora Holdings GmbH (hereinafter "AH") hired Dana Cole. Bolt Industries LLC paid AH. Dana Cole left.'
BOLT = "Recall_" + hashlib.md5(b"Bolt Industries LLC").hexdigest()[:12]


@pytest.fixture
def tables(spark):
    nodes = [("P1", "Person", "Dana Cole", "person", 0), ("C1", "Company", "Aurora Holdings GmbH", "company", 1), ("C2", "Company", "Aurora Holdings", "other", 2), ("R", "OntologyDocument", "doc", "other", 3)]
    nodes = spark.createDataFrame([("d", i, la, la, n, t, [], p) for i, la, n, t, p in nodes], "doc_id string, id string, label string, `__class__` string, name string, ontology_type string, aliases array<string>, pos long")
    edges = spark.createDataFrame([("d", "P1", "C2", "REPRESENTS", 0), ("d", "OntologyDocument_1", "P1", "HAS", 1)], "doc_id string, source string, target string, label string, pos long")
    anchors = spark.createDataFrame([("d", "Person", "Dana Cole", 0, "verbatim", 46, 55)], "doc_id string, node_type string, name string, chunk_id int, kind string, lo int, hi int")
    docs = spark.createDataFrame([("d", TEXT)], "doc_id string, text string")
    missed = [("Bolt Industries LLC", "company", "Bolt Industries LLC paid AH."), ("AH", "company", "paid AH"), ("Nobody", "person", "Dana"), ("bolt industries", "company", "Bolt"), ("paid", "other", "not there")]
    missed = spark.createDataFrame([("d", 0, p, *m) for p, m in enumerate(missed)], "doc_id string, chunk_id int, pos long, name string, type string, quote string")
    related = [("Dana Cole", "represents", "AH", "hired Dana Cole"), ("Bolt Industries LLC", "controls", "Aurora Holdings", "paid AH"), ("AH", "governs", "Dana Cole", "AH"), ("AH", "controls", "Nobody", "AH"), ("AH", "controls", "Dana Cole", "never said")]
    related = spark.createDataFrame([("d", p, *r) for p, r in enumerate(related)], "doc_id string, pos long, subject string, relation string, object string, quote string")
    return nodes, edges, anchors, chunk.chunks(docs), docs, missed, related


def test_whole_run(tables):
    done = runs.run(*tables)
    ents = {r.entity_id: r for r in done["entities"].collect()}
    assert set(ents) == {"P1", "C1", BOLT}
    assert (ents["C1"].canonical_name, ents["C1"].entity_type, sorted(ents["C1"].aliases)) == ("Aurora Holdings GmbH", "company", ["AH", "Aurora Holdings"])
    assert [(c.start_char, c.quote, c.match) for c in ents["P1"].citations] == [(46, "Dana Cole", "verbatim")]
    assert [(c.quote, c.match) for c in ents[BOLT].citations] == [("Bolt Industries LLC paid AH.", "verbatim")]
    assert [r.reject for r in done["missed"].orderBy("pos").collect()] == [None, "duplicate", "not_in_text", "duplicate", "no_evidence"]
    assert [r.reject for r in done["related"].orderBy("pos").collect()] == [None, None, "bad_direction", "unresolved", "no_evidence"]
    rels = {(r.source, r.relation, r.target): (r.match, TEXT[r.start_char : r.end_char]) for r in done["relationships"].collect()}
    assert set(rels) == {("P1", "represents", "C1"), (BOLT, "controls", "C1")} and rels[BOLT, "controls", "C1"] == ("verbatim", "paid AH")
    assert rels["P1", "represents", "C1"][0] == "cooccurrence" and "hired Dana Cole" in rels["P1", "represents", "C1"][1]


def test_replays_change_one_pass_alone(tables):
    nodes, edges, anchors, chunks, docs, missed, related = tables
    ents, rels = runs.settle(*convert.convert_documents(nodes, edges, anchors, chunks, docs), docs)
    stored = {"entities": ents, "relationships": rels}
    again = runs.replay_recall(stored, docs, chunks, missed)
    assert {r.entity_id for r in again["entities"].collect()} == {"P1", "C1", BOLT} and again["relationships"].count() == 1
    made = runs.replay_relations(stored, docs, related, keep=False)
    assert made["relationships"].count() == 1 and [r.reject for r in made["related"].orderBy("pos").collect()] == [None, "unresolved", "bad_direction", "unresolved", "no_evidence"]
    kept = runs.replay_relations(stored, docs, related)
    assert kept["relationships"].count() == 1 and kept["entities"].count() == ents.count()


def test_relation_records_and_runs_without_proposals(spark, tables):
    nodes, edges, anchors, chunks, docs, *_ = tables
    records = nodes.selectExpr("*", "cast(null as string) AS subject", "cast(null as string) AS object", "cast(null as string) AS relation", "cast(null as string) AS evidence")
    more = [("R1", "dana cole", "Aurora Holdings GmbH", None, "hired   Dana Cole"), ("R2", "Dana Cole", "Dana Cole", "controls", ""), ("R3", "Dana Cole", "Nobody", "controls", "")]
    more = spark.createDataFrame([("d", i, "Relationship", "Relationship", None, None, [], 10 + p, s, o, r, e) for p, (i, s, o, r, e) in enumerate(more)], records.schema)
    done = runs.run(records.union(more), edges, anchors, chunks, docs, None, None)
    assert "missed" not in done and {(r.source, r.relation, r.target, r.match, TEXT[r.start_char : r.end_char]) for r in done["relationships"].where("relation = 'related_to'").collect()} == {("P1", "related_to", "C1", "verbatim", "hired Dana Cole")}
    assert done["relationships"].count() == 2
