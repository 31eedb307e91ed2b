"""The stages on a planted corpus worked out by hand, and on odd rows."""

from __future__ import annotations

import collections

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NOTE = "Subscribe to our weekly letter now"
PASSAGE = " ".join(f"question{i}" for i in range(30))


def _words(rng, n, tag):
    return " ".join(tag + "".join("bdfgklmnprstvz"[int(k) // 14**j % 14] + "aeiou"[(int(k) + j) % 5] for j in range(3)) for k in rng.integers(0, 14**3, n))


def _letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


@pytest.fixture
def corpus(spark, tmp_path):
    rng = np.random.default_rng(12)
    texts = {i: _words(rng, 60, f"w{_letters(i)}x") for i in range(60)}
    bad = ["zorgh", "flurbig", "klaxxen"]
    texts |= {i: f"{_words(rng, 20, f't{_letters(i)}x')} {bad[i % 3]} {bad[(i + 1) % 3]} {_words(rng, 9, 'r')}" for i in range(60, 90)}
    want = {i: t for i, t in texts.items() if i < 60}
    for i in range(10):
        texts[i] += f"\n{NOTE}"
    want[0] = texts[0]
    base = texts[100] = want[100] = _words(rng, 200, "n")
    texts[101] = base + " last"
    long = _words(rng, 300, "m")
    texts[110] = f"{long} {PASSAGE} {long[::-1]}"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 90)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", want, (long, long[::-1])


def test_pipeline_on_a_planted_corpus(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, want, (before, after) = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    left = {r.doc_id: r.text for r in docs.collect()}
    cleaned = left.pop(110)
    assert left == want and PASSAGE not in cleaned and "question" not in cleaned and before in cleaned and after in cleaned
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.defaultdict(bytes)
    for r in sorted(corpus_pipeline.run(spark, path).collect(), key=lambda r: (r.doc_id, r.start)):
        ids[r.doc_id] += bytes(r.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in ids.items()} == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in (left | {110: cleaned}).items()}


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, corpus, stage):
    path, _, _ = corpus
    long = "long " * 30_000
    rows = [(1, None), (2, ""), (None, "a text without an id"), (3, "same words in both of these rows"), (3, "same words in both of these rows"), (3, "another text of the same id here"), (4, long), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], SCHEMA + ", uid string, doc string, score int").repartition(2)
    kept = corpus_pipeline.STAGES[stage][1](spark, docs, path)
    assert kept.columns == docs.columns
    counts = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    want = collections.Counter(rows)
    if corpus_pipeline.STAGES[stage][0] == "near_dedup":
        want[rows[3]] = 1
    assert counts == want
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), path).count() == 0


def test_shards_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["hot " * 9] * 500 + [f"t{i // 2} {'y' * int(rng.integers(0, 300))}" if i % 2 else f"t{i // 2}" for i in range(900)] + [f"pair {i // 2}" for i in range(60)] + [None, "z" * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = sorted(((r["key"], r["id"], r["size"]) for r in sharding.digest_rows(df).collect()))
    total, n = sum(r[2] for r in rows), 7
    group = collections.Counter()
    for key, _, size in rows:
        group[key >> 32] += size
    ends, done = {}, 0
    for key, _, size in rows:
        done += size
        ends[key >> 32] = done
    want, fill, done = {}, collections.Counter(), 0
    for key, i, size in rows:
        done += size
        g = key >> 32
        middle = ends[g] - group[g] / 2 if group[g] <= 0.02 * total / n else done - size / 2
        shard = min(int(middle * n / total), n - 1)
        want[i] = shard, fill[shard]
        fill[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(df, n_shards=n).collect()} == want
