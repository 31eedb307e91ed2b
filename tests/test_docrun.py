"""A run of a document in one row has the results of the passes that are composed of joins."""

from __future__ import annotations

import random

from factloom.operators import chunk, convert, docrun, runs

WORDS = ["Aurora", "Bolt", "Cole", "Dana", "Echo", "GmbH", "Holdings", "The", "met", "paid", "aurora", "Straße"]


def _documents(spark):
    """Made-up graphs with names that meet, texts with definitions, proposals that are new, known, repeated or not there."""
    r = random.Random(7)
    name = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))
    nodes, edges, anchors, docs, missed, related = [], [], [], [], [], []
    for d in range(40):
        names = [name() for _ in range(6)]
        text = f'{names[0]} (hereinafter "{r.choice(["AH", "Bolt", "Echo"])}") met {names[1]}.\n' + " ".join(name() for _ in range(30)) + "\n\n" + ". ".join(names)
        docs.append((d, None if d == 5 else text))
        for i, n in enumerate(names):
            kind = r.choice(["Company", "Person", "Asset"])
            nodes.append((d, f"N{i}", kind, kind, n, r.choice([kind.lower(), "other", "thing"]), r.sample(WORDS, 1) if i % 3 == 0 else [], i, None, None, None, None))
        nodes.append((d, "R", "Relationship", "Relationship", None, "other", [], 9, names[0], names[2], "controls", names[1]))
        edges += [(d, f"N{r.randrange(6)}", f"N{r.randrange(7)}", r.choice(["OWNS", "REPRESENTS"]), p) for p in range(4)]
        anchors.append((d, "Company", names[0], 0, "verbatim", 0, len(names[0])))
        missed += [(d, r.randrange(3), 2 * p, f" {x}", r.choice(["other", "company"]), r.choice([x, text[3:20], "a u r o r a  b o l t", "not there", ""])) for p, x in enumerate(r.choice([name(), r.choice(names)]) for _ in range(12))]
        related += [(d, 20 + p, r.choice(names), r.choice(["controls", "represents", "related_to", "owns"]), r.choice([*names, "Bolt", "ghost"]), r.choice([names[1], "nowhere", text[5:15]])) for p in range(6)]
    nodes.append((99, "N0", "Company", "Company", "Without Text", "company", [], 0, None, None, None, None))
    make = spark.createDataFrame
    docs = make(docs, "doc_id long, text string")
    return (
        make(nodes, "doc_id long, id string, label string, `__class__` string, name string, ontology_type string, aliases array<string>, pos long, subject string, object string, relation string, evidence string"),
        make(edges, "doc_id long, source string, target string, label string, pos long"), make(anchors, "doc_id long, node_type string, name string, chunk_id int, kind string, lo int, hi int"),
        chunk.chunks(docs, most=60).localCheckpoint(), docs, make(missed, "doc_id long, chunk_id int, pos long, name string, type string, quote string"), make(related, "doc_id long, pos long, subject string, relation string, object string, quote string"),
    )


def _rows(df, *columns):
    return sorted((repr(r) for r in df.select(*columns).collect()))


def test_a_document_in_a_row_has_the_results_of_the_passes(spark, monkeypatch):
    nodes, edges, anchors, chunks, docs, missed, related = _documents(spark)
    ents, rels = convert.convert_documents(nodes, edges, anchors, chunks, docs)
    ents, rels = ents.localCheckpoint(), rels.localCheckpoint()
    a, b = runs.settle(ents, rels, docs)
    a, checked = runs.recall_pass(a, docs, chunks, missed)
    a, b = runs.settle(a.localCheckpoint(), b, docs)
    b, links = runs.relation_pass(a, b, docs, related)
    monkeypatch.setattr(runs, "settle", None)
    monkeypatch.setattr(runs.convert, "convert_documents", lambda *x: (ents, rels))
    done = runs.run(nodes, edges, anchors, chunks, docs, missed, related)
    assert _rows(done["entities"], *a.columns) == _rows(a, *a.columns) and a.where("doc_id = 99").count() == 1
    assert _rows(done["relationships"], *b.columns) == _rows(b, *b.columns)
    assert set(done["missed"].columns) == set(checked.columns) - {"chunk_key"} and set(done["related"].columns) == set(links.columns)
    assert _rows(done["missed"], *done["missed"].columns) == _rows(checked, *done["missed"].columns)
    assert _rows(done["related"], *links.columns) == _rows(links, *links.columns)
    seen = {r.reject for r in checked.collect()} | {r.reject for r in links.collect()}
    assert seen == {None, "not_in_text", "duplicate", "no_evidence", "unresolved", "bad_direction"} and a.where("startswith(entity_id, 'Recall_')").count() > 5


def test_rows_of_one_document_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    nodes, edges, anchors, chunks, docs, missed, related = _documents(spark)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = missed.count()
    done = runs.run(nodes, edges, anchors, chunks, docs, missed.mapInArrow(counted, missed.schema), related)
    assert done["entities"].count() and done["relationships"].count() and done["missed"].count()
    assert made.value == n


def test_names_of_merged_entities_need_one_more_pass():
    keys = {"AH": docrun.Key("ah", "ah", False), "Aurora GmbH": docrun.Key("aurora", "auroragmbh", True), "Aurora": docrun.Key("aurora", "aurora", False), None: docrun.Key("", "", False)}
    ents = [docrun.Entity("N1", 1, "Aurora", "other", ["AH"], [(0, 1, "A", "verbatim")]), docrun.Entity("N0", 0, "Aurora GmbH", "company", [], [(0, 1, "A", "verbatim")])]
    rows, _ = docrun.settle(ents, [], [], keys)
    assert rows == [docrun.Entity("N0", 0, "Aurora GmbH", "company", ["Aurora", "AH"], [(0, 1, "A", "verbatim")])]
