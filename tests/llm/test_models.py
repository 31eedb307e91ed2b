"""Toxicity, language model, pipeline and registry."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np

from factloom.llm import lm_score, toxicity

SF = "/root/testdata/sf0.001"


def _corpus(n=900, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ba", "lo", "mi", "ru", "te", "zo") for b in ("n", "rk", "st", "lla", "mm")]
    bad = ["zorgh", "flurbig", "klaxxen", "snorbel", "grukked"]
    rows = []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(20, 60)))
        toxic = i % 6 == 0
        if toxic:
            for p in rng.integers(0, len(w), 3):
                w[p] = str(rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_learns_held_out_labels(spark):
    rows = _corpus() + [(5000, None, 0), (5001, "", 0), (5002, "clean " * 50_000, 0), (5003, "so zorgh, a flurbig and klaxxen snorbel", 1)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(5001, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 10 != 1], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).toPandas()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) + 1 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]]
    assert np.mean([truth[i] == p for i, p in zip(held["doc_id"], held["predicted"], strict=True)]) > 0.97
    assert got[got["doc_id"] == 5000]["score"].iloc[0] == got[got["doc_id"] == 5001]["score"].iloc[0] < 0.5
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 5003").count() == 0 and kept.where("doc_id >= 5000 and doc_id < 5003").count() == 4


def test_toxicity_ignores_held_out_labels(spark):
    rows = _corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = toxicity.scores(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.scores(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {r.doc_id: r.score for r in a.collect()} == {r.doc_id: r.score for r in b.collect()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.scores(docs, none).collect()] == [0, 0]
    assert toxicity.scores(docs.limit(0), none).count() == 0


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(1)
    m = len(toxicity.VOTERS)
    y = rng.random(40_000) < 0.2
    v = rng.random((len(y), m)) < np.where(y[:, None], 0.7, 0.03)
    v[:, 5] = np.where(rng.random(len(y)) < 0.9, v[:, 4], v[:, 5])
    patterns, counts = np.unique(v @ (1 << np.arange(m)), return_counts=True)
    fit = toxicity.fit_label_model(patterns, counts.astype(float))
    assert abs(fit["rates"][1][0] - 0.7) < 0.05 and abs(fit["rates"][0][0] - 0.03) < 0.02
    assert fit["parent"][5] == 4 or fit["parent"][4] == 5
    assert fit["correlations"][1][4, 5] > 5 * abs(fit["correlations"][1][0, 1])


def test_label_model_beats_any_vote_and_the_majority_on_rows_it_has_not_seen():
    """Two copies of one weak voter mislead counts of votes; the tree sees that they are one."""
    rng = np.random.default_rng(8)
    m = len(toxicity.VOTERS)
    right = np.array([0.8, 0.75, 0.7, 0.8, 0.75, 0.3, 0.3, 0.2, 0.2, 0.1])
    wrong = np.array([0.05, 0.05, 0.05, 0.05, 0.05, 0.02, 0.02, 0.3, 0.3, 0.02])

    def draw(n):
        y = rng.random(n) < 0.1
        v = rng.random((n, m)) < np.where(y[:, None], right, wrong)
        v[:, 8] = np.where(rng.random(n) < 0.95, v[:, 7], v[:, 8])
        return y, v @ (1 << np.arange(m)), v

    _, patterns, _ = draw(60_000)
    known, counts = np.unique(patterns, return_counts=True)
    fit = toxicity.fit_label_model(known, counts.astype(float))
    y, patterns, v = draw(20_000)
    posterior = np.interp(np.searchsorted(known, patterns), np.arange(len(known)), fit["posterior"])
    wrongs = lambda p: np.mean(p != y)
    best = min(wrongs(v.sum(axis=1) >= k) for k in range(1, m))
    assert wrongs(posterior >= 0.5) < 0.9 * best < wrongs(v.any(axis=1))


def test_long_words_and_ties_of_the_lexicon(spark):
    long = "z" * 70_000
    rows = [(i, f"{long} vile{i % 2}" if i % 2 else f"fine text {i % 3}") for i in range(80)]
    got = toxicity.scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    assert {(r.doc_id % 2, r.predicted) for r in got.collect()} == {(0, 0), (1, 1)}


def test_clean_keeps_columns_of_any_name(spark):
    rows = _corpus(120)
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in rows], "doc_id long, text string, doc string").selectExpr("*", "0.5D AS score")
    kept = toxicity.clean(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert kept.dtypes == docs.dtypes and 80 < kept.count() < 120


def _tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]


def test_base_scores_against_brute_force(spark):
    rows = [(i, f"{t} rare{i}" if i % 4 == 0 else t) for i, t, _ in _corpus(160, 3)] + [(900, None), (901, ""), (902, "LONG text " * 6000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in _tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for most in (16_000_000, 20):
        got = {r.doc_id: r for r in lm_score.scores(docs, warm_tokens=5_000, rounds=1, most_words=most).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            w = _tokens(t)
            want = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
            assert abs(got[i].base_score - want) < 1e-6 * max(1, abs(want)) and got[i].n_tokens == len(w) and got[i].n_known == sum(counts[x] > 0 for x in w)
            assert got[i].train_tokens == total and got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and got[i].score < 0


def test_repeated_ids_are_scored_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "a"), (3, "b c d")], "doc_id long, text string")
    for most in (100, 1):
        got = sorted((r.doc_id, r.n_tokens, round(r.base_score, 9)) for r in lm_score.scores(docs, warm_tokens=100, rounds=1, most_words=most).collect())
        assert [x[:2] for x in got] == [(1, 2), (1, 3), (1, 3), (2, 2), (3, 4)] and got[1] == got[2]


def test_scores_do_not_depend_on_the_size_of_the_word_table(spark):
    rows = [(i, f"{t} rare{i} rare{i % 50} other{i % 7}") for i, t, _ in _corpus(300, 4)] + [(900, None), (900, None), (901, "never seen"), (902, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm_score.scores(docs, warm_tokens=3_000, rounds=0, most_words=most).collect()) for most in (16_000_000, 60, 1)]
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2]


def test_every_training_document_is_trained_on(spark, monkeypatch):
    real = lm_score.fit

    def spy(coded, vocabulary, total, warm_tokens, *rest):
        def seen(keep):
            rows = coded(keep)
            asked.append({r.uid for r in rows.collect()})
            return rows

        return real(seen, vocabulary, total, warm_tokens, *rest)

    monkeypatch.setattr(lm_score, "fit", spy)
    docs = spark.createDataFrame([(i, f"{t} " * 400) for i, t, _ in _corpus(200, 5)], "doc_id long, text string").repartition(3)
    want = {r.uid for r in lm_score._rows(docs, "doc_id", "text").where(lm_score.is_training("id", 10)).collect()}
    for most in (16_000_000, 20):
        asked = []
        lm_score.scores(docs, warm_tokens=1_000, most_words=most)
        assert set().union(*asked[1:]) == want and sum(map(len, asked[1:])) == len(want)


def test_topics_come_from_all_training_documents(spark):
    seeds = np.eye(lm_score.TOPICS, lm_score.BUCKETS, dtype=np.float32)
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in _corpus(90, 6)], "id long, text string, uid long").repartition(3)
    import pyarrow as pa

    x = lm_score._profiles(*lm_score.tokens_of(pa.array([r.text for r in docs.collect()])))
    at = np.argmax(x @ seeds.T, axis=1)
    got = lm_score._topics(docs, seeds)
    for k in range(lm_score.TOPICS):
        want = x[at == k].sum(axis=0) / np.linalg.norm(x[at == k].sum(axis=0)) if (at == k).any() else seeds[k]
        assert np.allclose(got[k], want, atol=1e-5)


def test_language_model_beats_unigrams_on_held_out_text(spark):
    rng = np.random.default_rng(2)
    chains = [[f"{p}{i}" for i in range(30)] for p in ("x", "y", "z")]
    rows = [(i, " ".join(chains[i % 3][(int(s) + k) % 30] for k in range(40))) for i, s in enumerate(rng.integers(0, 30, 400))]
    got = lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string"), warm_tokens=30_000).where("held_out").toPandas()
    assert got["score"].sum() > 0.6 * got["base_score"].sum() and (got["score"] > got["base_score"]).mean() > 0.95


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = lm_score.scores(df).first()
    assert row.base_score == 0.0 and row.n_known == 0 and row.train_tokens == 0
    assert lm_score.scores(df.limit(0)).count() == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    codes, first = rng.integers(0, lm_score.UNSEEN, 40).astype(np.int16), np.array([0, 13, 40])
    q = lm_score.new_parameters(np.ones(lm_score.CODES))
    before = lm_score.log_likelihoods(q, codes, first).sum()
    for _ in range(30):
        lm_score.train(q, codes, first, 0.02, slots=2, window=8)
    assert lm_score.log_likelihoods(q, codes, first).sum() > 0.6 * before


def test_gradients_match_differences():
    """Every parameter's gradient over one window against central differences of the loss."""
    rng = np.random.default_rng(0)
    codes, first = rng.integers(0, lm_score.UNSEEN, 24).astype(np.int16), np.array([0, 9, 24])
    p = {k: v.astype(np.float64) for k, v in lm_score.new_parameters(rng.integers(1, 9, lm_score.CODES).astype(float)).items()}
    index, begins, _ = lm_score.deal(first, 2)
    _, grad, _ = lm_score.gradients(p, codes, index, begins, np.zeros((2, lm_score.HIDDEN)))
    mean = lambda q: -_brute_log_likelihoods(q, codes, first).mean()
    for key, value in grad.items():
        flat = np.argsort(-np.abs(value).ravel())[[0, 1, 5, 20]]
        for at in [*flat, *rng.integers(0, value.size, 3)]:
            at = np.unravel_index(at, value.shape)
            old, step = p[key][at], 1e-5
            p[key][at] = old + step
            up = mean(p)
            p[key][at] = old - step
            down = mean(p)
            p[key][at] = old
            assert abs((up - down) / (2 * step) - value[at]) < 1e-6 + 1e-4 * abs(value[at]), key


def _brute_log_likelihoods(p, codes, first):
    """Natural log probabilities token by token, from the equations."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, out = lm_score.HIDDEN, []
    for a, b in zip(first[:-1], first[1:], strict=True):
        h, before = np.zeros(n), lm_score.END
        for code in codes[a:b]:
            x, hu = p["g"][before], h @ p["u"]
            r, z = sigmoid(x[:n] + hu[:n]), sigmoid(x[n : 2 * n] + hu[n : 2 * n])
            cand = np.tanh(x[2 * n :] + r * hu[2 * n :])
            h = cand + z * (h - cand)
            before = int(code)
            classes = np.exp(h @ p["wc"] + p["bc"])
            classes /= classes.sum()
            if before == lm_score.UNSEEN:
                out.append(math.log(classes[lm_score.ONCE].sum() / 2))
                continue
            k = int(lm_score.class_of_code[before])
            value = math.log(classes[k])
            if before < lm_score.HEAD:
                members = np.exp(h @ p["wh"][k] + p["bh"][k])
                value += math.log(members[before % lm_score.HEAD_CLASS] / members.sum())
            out.append(value)
    return np.array(out)


def test_scores_against_brute_force(spark, monkeypatch):
    """Score: the network's probabilities token by token, and each rarer word's share of its class."""
    rows = [(i, f"{t} rare{i % 40}") for i, t, _ in _corpus(120, 7)] + [(900, None), (901, "never seen words"), (902, "LONG text " * 900)]
    kept = {}
    real = lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda coded, vocabulary, *rest: kept.setdefault("p", (real(coded, vocabulary, *rest), vocabulary.value))[0])
    got = {r.doc_id: r.score for r in lm_score.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), warm_tokens=3_000, rounds=1).collect()}
    p, vocab = kept["p"]
    p = {k: v.astype(np.float64) for k, v in p.items()}
    import pyarrow as pa

    for i, t in rows:
        hashes, first = lm_score.tokens_of(pa.array([t], pa.string()))
        counts, codes = vocab.find(hashes)
        total = _brute_log_likelihoods(p, codes, first).sum()
        for c, code in zip(counts, codes, strict=True):
            if lm_score.HEAD <= code < lm_score.END:
                same = vocab.counts[vocab.codes == code].sum()
                total += math.log(c / same / (2 if (code - lm_score.HEAD) % len(lm_score.BINS) == 0 else 1))
        assert abs(got[i] - total / math.log(10)) < 1e-3 * max(1, abs(got[i])), i


def test_scores_do_not_depend_on_slots_or_windows():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, lm_score.CODES, 600).astype(np.int16)
    first = np.array([0, 1, 2, 300, 310, 600])
    p = lm_score.new_parameters(np.ones(lm_score.CODES))
    a = lm_score.log_likelihoods(p, codes, first, slots=1, window=1000)
    b = lm_score.log_likelihoods(p, codes, first, slots=4, window=7)
    assert np.allclose(a, b, atol=1e-4)


def test_probabilities_sum_to_one():
    p = lm_score.new_parameters(np.arange(lm_score.CODES)[::-1].astype(float))
    total = 0.0
    for code in range(lm_score.UNSEEN + 1):
        got = math.exp(lm_score.log_likelihoods(p, np.array([code], np.int16), np.array([0, 1]))[0])
        k = code - lm_score.HEAD
        total += got / 2 if 0 <= k < lm_score.TAILS and k % len(lm_score.BINS) == 0 else got
    assert abs(total - 1) < 1e-4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{i}")
        made = spark.read.parquet(f"file://{tmp_path}/{i}")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == columns, name
            assert 0.6 * docs.count() < made.count() <= docs.count(), name
            docs = made
    assert {r.doc_id for r in made.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_every_operator_is_registered():
    import __spark_entry__

    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
