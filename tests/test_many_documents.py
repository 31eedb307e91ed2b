"""Formats of one document a file, with many documents in a file."""

from __future__ import annotations

import json

from factloom.sources import files, loaders


def test_provenance_of_many_documents_in_a_file(spark, tmp_path):
    one = lambda k: {"version": 1, "chunks": {"0": {"chunk_id": 0, "text": f"t{k}"}}, "nodes": {f"N|{k}": {"node_type": "Company", "ids": {"name": f"n{k}"}, "anchors": [{"document_id": "f", "chunk_id": 0, "kind": "verbatim", "span": [k, k + 1]}]}}}
    (tmp_path / "p.json").write_text("".join(json.dumps(one(k)) + "\n" for k in range(3)))
    anchors, chunks = files.provenance(spark, f"file://{tmp_path}/p.json", lines=True)
    assert sorted((r.name, r.lo, r.hi) for r in anchors.collect()) == [("n0", 0, 1), ("n1", 1, 2), ("n2", 2, 3)] and chunks.count() == 3


def test_legacy_labels_of_many_documents_in_a_file(spark, tmp_path):
    rows = [{"doc_id": f"d{k}", "entities": [{"entity_name": f"Acme {k}", "entity_type": "company"}], "relationships": [{"source": f"Acme {k}", "relationship": "controls", "target": "Bolt"}]} for k in range(3)]
    (tmp_path / "l.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = loaders.load(spark, "legacy", f"file://{tmp_path}", {"lines": True}).collect()
    assert {r.doc_id: (sorted(e.name for e in r.entities), [(x.source, x.target) for x in r.relations]) for r in got} == {f"d{k}": ([f"Acme {k}", "Bolt"], [("g0", "implied-bolt")]) for k in range(3)}
