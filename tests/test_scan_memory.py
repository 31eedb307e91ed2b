"""What a scan holds while a batch is in it."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from factloom.operators import automaton, chunk


def test_places_of_a_batch_are_numbers():
    texts, forms = pa.array(["a b " * 200] * 2_000), pa.array([["a", "b"]] * 2_000)
    tracemalloc.start()
    got = automaton._scanner(True, 0, False).func(texts, forms)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x in got) == 2_000 * 400 and got[0][1].as_py() == {"form": 1, "n": 0, "start_char": 2, "end_char": 3}
    assert held < 60 * 2_000 * 400  # as a row of Python objects a place took over 200 bytes


def test_odd_texts_and_forms_scan():
    texts, forms = pa.array([None, "", "xx", "xx x", None]), pa.array([["x"], ["x"], [], ["x", "xx"], ["x"]])
    got = automaton._scanner(False, 0, False).func(texts, forms).to_pylist()
    assert [len(g) for g in got] == [0, 0, 0, 4, 0]
    assert automaton._scanner(False, 0, False).func(pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_chunks_come_some_texts_at_a_time():
    rows = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(["a\nb"] * 999 + [None])], names=["doc_id", "text"])
    got = list(chunk.packed(iter([rows]), chunk.pack_paragraphs))
    assert max(b.num_rows for b in got) <= 256 and sum(b.num_rows for b in got) == 999
