"""Mixing sources: targets, quotas and places against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing

SF = "/root/testdata/sf0.001"


def _targets(sizes, weights, repeats=3):
    """Share by weight, cap, and share the excess again until none is above."""
    total, capped = sum(sizes.values()), set()
    while True:
        free = {s for s in sizes if s not in capped}
        rest = Fraction(total - sum(repeats * sizes[s] for s in capped))
        weight = sum(weights[s] for s in free)
        over = {s for s in free if weight and rest * weights[s] / weight > repeats * sizes[s]}
        if not over:
            return {s: Fraction(repeats * sizes[s]) if s in capped else (rest * weights[s] / weight if weight else Fraction(0)) for s in sizes}
        capped |= over


def _order(sources):
    return sorted(sources, key=lambda s: (s is None, (s or "").encode()))


def _brute(docs, n_shards, finest=512):
    """(doc_id, size, target, parts) by walking every word of every source's stream."""
    rows = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in docs]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    weights = {s: i % 3 + 1 for i, s in enumerate(_order(sizes))}
    targets = _targets(sizes, weights)
    some = [t for t in targets.values() if t > 0]
    block = max(1, min(1 << 20, int(min(some, default=1) / finest)))
    blocks = int(sum(some) / block + Fraction(1, 2))
    given, shard_of = Counter(), defaultdict(list)
    houses = [(2 * j * blocks + n_shards) // (2 * n_shards) for j in range(1, n_shards + 1)]
    for b in range(blocks):
        best = max((s for s in targets if targets[s] > 0), key=lambda s: (targets[s] / (2 * given[s] + 1), -_order(sizes).index(s)))
        given[best] += 1
        shard_of[best].append(next(j for j, h in enumerate(houses) if b < h))
    out = {}
    for s in sizes:
        stream = sorted(((int(hashlib.md5(f"42:{'' if d is None else d}".encode()).hexdigest()[:13], 16), d is not None, d or 0, n) for d, x, n in rows if x == s))
        words = [(i, w) for i, (*_, n) in enumerate(stream) for w in range(n)]
        found = defaultdict(Counter)
        for p in range(min(given[s] * block, 3 * len(words))):
            i, w = words[p % len(words)]
            found[i][shard_of[s][p // block], p // len(words)] += 1
        for i, (_, known, d, n) in enumerate(stream):
            out.setdefault((d if known else None, s, n), []).append(sorted((j, c, k) for (j, c), k in found[i].items()))
    return out, targets


def _docs(seed, sizes):
    rng = np.random.default_rng(seed)
    docs = []
    for source, n in sizes.items():
        docs += [(int(rng.integers(1 << 40)), " ".join(["w"] * int(rng.integers(0, 60))), source) for _ in range(n)]
    return docs


@pytest.mark.parametrize("sizes", [{"a": 30, "b": 5, "é": 12, "Z": 3, None: 8}, {"a": 120, "b": 1}, {f"s{i}": 4 for i in range(12)}])
def test_parts_against_every_word(spark, sizes):
    docs = _docs(len(sizes), sizes) + [(7, None, "a"), (8, "", "b"), (9, " \n", "empty"), (5, "x y z", "a"), (5, "x y z", "a"), (None, "p q", "a"), (11, "long " * 3_000, "a")]
    want, targets = _brute(docs, 4, finest=40)
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, source string, size int").repartition(3)
    got = defaultdict(list)
    for r in mixing.mix(df, n_shards=4, finest=40).collect():
        assert r.target == pytest.approx(float(targets[r.source]))
        assert all(0 <= p.start and p.start + p.words <= r["size"] for p in r.parts)
        got[r.doc_id, r.source, r["size"]].append(sorted((p.shard, p.copy, p.words) for p in r.parts))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_order_by_quotients(spark):
    """Quotas of nested houses against the plain order of all quotients, equal targets too."""
    rng = np.random.default_rng(3)
    targets = [float(x) for x in rng.integers(1, 50, 25)] + [5.0, 5.0, 5.0, 1e6, 0.0]
    sources = spark.createDataFrame([(f"k{i}", i, t) for i, t in enumerate(targets)], "key string, place long, target double")
    houses = [0, 1, 7, 7, 500, 20_011]
    given, want, done = Counter(), [], 0
    for h in houses:
        while done < h:
            given[max((i for i, t in enumerate(targets) if t), key=lambda i: (targets[i] / (2 * given[i] + 1), -i))] += 1
            done += 1
        want.append(dict(given))
    got = {r["key"]: r.seats for r in mixing.quotas(sources, houses).collect()}
    assert got == {f"k{i}": [w.get(i, 0) for w in want] for i in range(len(targets))}


def test_same_at_any_partitioning_and_given_weights(spark):
    docs = spark.createDataFrame(_docs(5, {"a": 40, "b": 20, "c": 10}), "doc_id long, text string, source string")
    one, many = (sorted(mixing.mix(docs.repartition(n), block=7).collect()) for n in (1, 9))
    assert one == many
    weights = spark.createDataFrame([("a", 1), ("b", 1)], "source string, weight long")
    shares = {r.source: (r.t, r.target) for r in mixing.mix_documents(docs, weights=weights).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert shares["c"] == (0, 0.0) and abs(shares["a"][0] - shares["b"][0]) <= 4


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, None), (2, " ", "a")], empty.schema)
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_documents(wordless).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet")).select(*want.columns).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want.astype(got.dtypes.to_dict()))
