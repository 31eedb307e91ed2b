"""Importance resampling: CRCs, gains, the merge, and whole draws against brute force; odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import resample
from factloom.llm import wordarrays as wa

SF = "/root/testdata/sf0.001"
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _features(text):
    w = re.findall(WORD, (text or "").encode().lower())
    return len(w), [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _brute(docs, target, percent, min_words, buckets):
    def bucket(f):
        return zlib.crc32(f) % buckets

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, _features(text)[1]))
    for text in target:
        t.update(map(bucket, _features(text)[1]))
    ss, tt = sum(s.values()), sum(t.values())
    rows = []
    for d, text in docs:
        n, features = _features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    order = sorted((-r[3], r[0] is not None, r[0] or 0) for r in rows if r[4])[: percent * sum(r[4] for r in rows) // 100]
    return [r[:4] for r in rows], [(rank + 1, d if known else None, -s) for rank, (s, known, d) in enumerate(order)]


def _rows(got, name="doc_id"):
    rows = [(r[name], r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    return sorted((r[:4] for r in rows), key=repr), sorted((r[4], r[0], r[3]) for r in rows if r[4] is not None)


def _texts(rng, n, words):
    vocabulary = np.array([f"w{i}" for i in range(200)] + ["Été", "A-b", "x_y"])
    return [" ".join(rng.choice(vocabulary, rng.integers(0, words))) for _ in range(n)]


def test_crcs_of_ngrams():
    texts = pa.array(["Ab cd é x9", None, "", "one", "z" * 200 + " q " + "y" * 64 + " r " + "k" * 65, "a b " * 50_000])
    words = wa.words_of(texts, wa.ALNUM)
    folded = wa.ALNUM[words.data]
    spelled = [folded[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    for k, crcs in enumerate(resample.ngram_crcs(words, folded)):
        assert crcs.tolist() == [zlib.crc32(b" ".join(spelled[i : i + k + 1])) for i in range(len(spelled) - k)]
    assert [len(x) for x in resample.ngram_crcs(wa.words_of(pa.array(["one"]), wa.ALNUM), np.frombuffer(b"one", np.uint8))] == [1, 0, 0]


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 8, 13])
def test_tournament_gives_the_order_of_all(runs):
    rng = np.random.default_rng(runs)
    lists = [sorted((int(rng.integers(0, 20)), r, i) for i in range(int(rng.integers(0, 12)))) for r in range(runs)]
    assert [lists[r][i] for r, i in resample.tournament(lists)] == sorted(x for r in lists for x in r)


@pytest.mark.parametrize("options", [{}, {"rows_per_range": 3, "run_rows": 10}])
def test_draw_against_brute_force(spark, options):
    rng = np.random.default_rng(11)
    same = "w1 w2 w3 w4 w5"
    docs = list(enumerate(_texts(rng, 400, 30))) + [(1000, None), (1001, ""), (None, "w5 " * 30), (1002, "W9 w8 " * 20_000)] + [(7_000_000, same)] * 150
    target = [*_texts(rng, 20, 20), None, "", same]
    left = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, score int").repartition(5)
    right = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    want = _brute(docs, target, 30, 5, 500)
    rows, ranks = _rows(resample.resample(left, right, percent=30, min_words=5, buckets=500, **options))
    assert rows == sorted(want[0], key=repr) and ranks == want[1]


def test_any_partitioning_draws_the_same(spark):
    scored = spark.range(5_000).select("id", F.lit(1).cast("long").alias("n_features"), F.lit(2).cast("long").alias("weight"), (F.col("id") % 7).alias("score"), (F.col("id") % 3 != 0).alias("able"))
    first, second = ({(r.id, r["rank"]) for r in resample.draw(scored.repartition(n), 5, rows_per_range=100).collect()} for n in (2, 9))
    drawn = 5 * 3_333 // 100
    assert first == second and sorted(r for _, r in first if r) == list(range(1, drawn + 1)) and len(first) == 5_000
    best = sorted((-(i % 7), i) for i in range(5_000) if i % 3)[:drawn]
    assert sorted((r, i) for i, r in first if r) == [(k + 1, i) for k, (_, i) in enumerate(best)]


def test_empty_tables_and_draws(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    target = spark.createDataFrame([("a",)], "text string")
    assert resample.resample(docs.limit(0), target).count() == 0
    assert _rows(resample.resample(docs, target.limit(0)))[1] == []
    assert resample.resample(docs, target).count() == 2


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = resample.resample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = con.execute(resample.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
