"""Ranked lexical search against scores of every document, and odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text):
    return re.findall(TERM, (text or "").encode().lower())


def _brute(docs, items, k):
    tf = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * n * n_docs // total))) for w in _terms(text) if c[w])
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def _texts(rng, n, words):
    vocabulary = np.array([f"w{i}" for i in range(300)] + ["Été", "été", "x1", "A-b"])
    share = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, rng.integers(0, words), p=share / share.sum())) for _ in range(n)]


@pytest.mark.parametrize(("k", "shard_postings", "block_bytes"), [(5, 2_000_000, 4 << 20), (5, 40, 30_000), (1, 300, 4 << 20)])
def test_against_every_document(spark, k, shard_postings, block_bytes):
    rng = np.random.default_rng(k + shard_postings)
    docs = list(enumerate(_texts(rng, 250, 60))) + [(7, "w1 w2 w2"), (7, "w1 w2 w2"), (900, None), (901, ""), (902, "., -"), (None, "w1 w1 w3"), (903, "W1 w2 " * 4_000), (904, "y" * 70_000 + " w9")]
    items = list(enumerate(_texts(rng, 25, 12))) + [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1 W1 w250"), (5, "w7 w8"), (104, "y" * 70_000)]
    left = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(3)
    right = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = lexical.search(left, right, k=k, shard_postings=shard_postings, block_bytes=block_bytes)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == _brute(docs, items, k)


def test_pruned_search_equals_whole_sums():
    """Many shards at once: bounds leave out only documents that can't be among the k best."""
    rng = np.random.default_rng(4)
    terms = lexical.terms_of(_texts(rng, 30, 25))
    count, offsets, number, times = lexical.posting_lists(pa.array(_texts(rng, 600, 80)), terms)
    weights = rng.integers(0, 4_000, len(terms.hashes))
    shard = lexical.Shard(75 + count, offsets, number, times, weights)
    skipped = 0
    for query in terms.queries:
        scores = np.zeros(600, np.int64)
        for t, q in query:
            np.add.at(scores, shard.docs[shard.first[t] : shard.first[t + 1]], q * shard.parts[shard.first[t] : shard.first[t + 1]])
        kth = max(1, lexical._kth(scores, 10))
        docs, found, least = shard.search(query, 10)
        assert least == kth and sorted(zip(docs, found, strict=True)) == [(d, s) for d, s in enumerate(scores) if s >= kth]
        better = shard.search(query, 10, kth + 1)
        assert sorted(better[0]) == [d for d, s in enumerate(scores) if s > kth]
        skipped += len(query) > 3
    assert skipped


def test_equal_hashes_are_told_apart():
    terms = lexical.terms_of(["alpha beta"])
    terms.hashes = np.repeat(terms.hashes[:1], 2)  # both terms under the hash of the first
    first = terms.words[0].decode()
    *_, number, times = lexical.posting_lists(pa.array([f"{first} {first} gamma"]), terms)
    assert [(terms.words[i].decode(), int(n)) for i, n in zip(number, times, strict=True)] == [(first, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items).count() == 1


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = lexical.search(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = con.execute(lexical.ORACLE_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
