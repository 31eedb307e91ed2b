"""Line files read in splits of any size against reading them line by line, and keyed tables written twice."""

from __future__ import annotations

import random

import pytest

from factloom.sources import files, loaders

TAGS = ["O", "B-PER", "I-PER", "B-LOC", ""]


def _by_lines(text, per, sep=" "):
    """(doc, sent, pos, token, tag) by the rules as they are said."""
    out, doc, sent, seen, mark, tokens = [], 0, 0, False, False, []

    def close():
        nonlocal doc, sent, seen, mark, tokens
        if not tokens:
            return
        seen |= mark
        if sent and (mark if seen else sent >= per):
            doc, sent = doc + 1, 0
        out.extend((doc, sent, i, *t) for i, t in enumerate(tokens))
        sent, tokens, mark = sent + 1, [], False

    for line in text.split("\n"):
        if line.startswith("-DOCSTART-"):
            close()
            mark = True
        elif not line.strip():
            close()
        else:
            head, _, tag = line.rpartition(sep)
            tokens.append((head.strip() or line.strip(), tag.strip()))
    close()
    return out


def _file(rng, lines):
    out = []
    for _ in range(lines):
        kind = rng.random()
        out.append("-DOCSTART- O" if kind < 0.06 else rng.choice(["", "  "]) if kind < 0.3 else rng.choice(["New York", "Ünal", "x", "a-b"]) + " " + rng.choice(TAGS) if kind < 0.95 else "alone")
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_conll_rows_at_any_split_size(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = {f"f{i}.txt": _file(rng, 150) for i in range(2)} | {"unmarked.txt": _file(rng, 150).replace("-DOCSTART- O", "")}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = sorted((name, *row) for name, text in texts.items() for row in _by_lines(text, 5))
    for size in ("64b", "301b", "100m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = loaders.conll_tokens(spark, str(tmp_path), per=5)
            assert sorted(map(tuple, rows.select("path", "doc", "sent", "pos", "token", "tag").collect())) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_conll_tokens_are_not_exchanged_and_know_their_document(spark, tmp_path):
    lines = ""
    for d in range(9):
        lines += f"-DOCSTART- O\n\nid{d} ID\n\n" + "".join(f"w{d}_{i} O\n" + "\n" * (i % 4 == 3) for i in range(d * 3))
    (tmp_path / "f.txt").write_text("early O\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = loaders.conll_tokens(spark, str(tmp_path), head=True)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan  # no exchange but that of a row a split
        got = rows.select("token", "head").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [("early", None)] + [(t, f"id{d}") for d in range(9) for t in [f"id{d}", *(f"w{d}_{i}" for i in range(d * 3))]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_keyed_rows_written_twice_stay_one(spark, tmp_path):
    path = f"file://{tmp_path}/scores"
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    read = lambda: sorted(map(tuple, files.read_keyed(spark, path).select("k", "v").collect()))
    first = [(f"k{i}", i) for i in range(50)]
    for _ in range(2):
        files.upsert(frame(first), path, "k", buckets=4)
        assert read() == sorted(first)
    files.upsert(frame([("k3", -3), ("new", 1), ("k3", -3)]), path, "k", buckets=4)
    want = dict(first) | {"k3": -3, "new": 1}
    assert read() == sorted(want.items())
    files.upsert(frame([]), path, "k", buckets=4)
    assert read() == sorted(want.items())


def test_a_write_that_never_committed_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/scores"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    files.upsert(df, path, "k", buckets=2)
    df.selectExpr("k", "v + 10 AS v", "0 AS bucket").write.partitionBy("bucket").parquet(f"{path}/data/version=lost")
    assert sorted(map(tuple, files.read_keyed(spark, path).select("k", "v").collect())) == [("a", 1), ("b", 2)]
    files.upsert(df.selectExpr("k", "v + 1 AS v"), path, "k", buckets=2)
    assert sorted(map(tuple, files.read_keyed(spark, path).select("k", "v").collect())) == [("a", 2), ("b", 3)]
