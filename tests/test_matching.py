"""Matching against brute force: many names in a text, similar names, assignments, co-occurrence, the indexed fold."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.operators import anchor, automaton, grouped, metrics, resolve, similar

LETTERS = "abAB "


def _word(rng, least=1, most=5, letters=LETTERS):
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def _places(text, form):
    out, at = [], text.find(form)
    while at >= 0 and form:
        out.append((at, at + len(form)))
        at = text.find(form, at + len(form))
    return out


@pytest.mark.parametrize("ignore_case", [False, True])
def test_automaton_equals_one_search_per_name(ignore_case):
    rng = random.Random(ignore_case)
    low = automaton.fold_case if ignore_case else str
    for _ in range(200):
        forms, text, limit = [_word(rng, 0) for _ in range(rng.randint(0, 6))], _word(rng, 0, 60, LETTERS + "İß"), rng.choice([0, 1, 2])
        want = [(i, n, a, b) for i, f in enumerate(forms) for n, (a, b) in enumerate(_places(low(text), low(f))) if not limit or n < limit]
        assert sorted(automaton.Names(forms, ignore_case).places(text, limit)) == sorted(want)


def test_leftmost_longest_equals_a_scan():
    rng = random.Random(5)
    for _ in range(200):
        forms, text = [_word(rng, 1, 4, "ab") for _ in range(4)], _word(rng, 0, 40, "abc")
        want, at = [], 0
        while at < len(text):
            here = [f for f in forms if text.startswith(f, at)]
            if here:
                want.append((forms.index(max(here, key=len)), at, at + len(max(here, key=len))))
            at += len(max(here, key=len)) if here else 1
        every = [(i, a, a + len(f)) for i, f in enumerate(forms) for a in range(len(text)) if text.startswith(f, a)]
        assert automaton.leftmost_longest(every) == want


def test_forms_of_documents(spark):
    texts = [("d1", 1, "Acme met ACME Corp"), ("d1", 2, "corp"), ("d2", 1, "Acme"), ("d3", 1, None), ("d4", 1, "")]
    forms = [("d1", "E1", "Acme"), ("d1", "E2", "Acme Corp"), ("d1", "E3", "acme"), ("d1", "E4", ""), ("d1", "E5", None), ("d3", "E1", "x"), ("d9", "E1", "Acme")]
    left, right = spark.createDataFrame(texts, "doc_id string, c int, text string"), spark.createDataFrame(forms, "doc_id string, id string, form string")
    want = {(1, "E1", 0, 0), (1, "E1", 1, 9), (1, "E3", 0, 0), (1, "E3", 1, 9), (1, "E2", 0, 9)}
    for automata in (1, 3):
        got = automaton.find_forms(left, right, ignore_case=True, automata=automata).collect()
        assert {(r.c, r.id, r.n, r.start_char) for r in got} == want and {r.doc_id for r in got} == {"d1"}
    longest = automaton.find_forms(left, right, ignore_case=True, longest=True).collect()
    assert {(r.id, r.n, r.start_char, r.end_char) for r in longest} == {("E1", 0, 0, 4), ("E2", 1, 9, 18)}


def _variants(rng, n, letters="abcdef"):
    base = [_word(rng, 1, 30, letters) for _ in range(max(1, n // 5))]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(s))
            if rng.random() < 0.5 and at < len(s):
                del s[at]
            else:
                s.insert(at, rng.choice(letters))
        out.append("".join(s))
    return out


def _ratio(a, b):
    return 2 * fuzzy.lcs(a, b) / (len(a) + len(b)) if a or b else 0.0


@pytest.mark.parametrize("least", [0.75, 0.9, 1.0])
def test_segments_lose_no_similar_pair(spark, least):
    rng = random.Random(int(least * 100))
    left, right = ([("ab"[i % 2], i, s) for i, s in enumerate(_variants(rng, 150))] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "scope string, id int, s string")
    close = lambda found: {(r.a, r.b) for r in found.collect() if _ratio(r.sa, r.sb) >= least}
    assert close(similar.candidates(frame(left), frame(right), least)) == {(i, j) for x, i, s in left for y, j, t in right if x == y and s and t and _ratio(s, t) >= least}
    assert close(similar.self_candidates(frame(left), least)) == {(i, j) for x, i, s in left for y, j, t in left if x == y and i < j and s and t and _ratio(s, t) >= least}


def test_segments_skip_most_pairs(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([("d", i, _word(rng, 18, 22, "abcdefghijklmnopqrstuvwxyz")) for i in range(400)], "scope string, id int, s string")
    assert similar.self_candidates(rows).count() < 400
    with pytest.raises(ValueError, match="ratio"):
        similar.self_candidates(rows, 0.5)


def test_name_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    names = [f"{rng.choice(['Aurora', 'The Aurora', 'Borealis'])} {rng.choice(['Steel', 'Stell', 'Paper', 'Papers'])} {rng.choice(['GmbH', 'Inc.', 'Holdings', ''])}".strip() for _ in range(40)] + ["...", "", "(x)"]
    rows = [("d", i, [n, n.upper()] if i % 3 else [n]) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id string, id int, forms array<string>")
    pairs = df.select("doc_id", F.col("id").alias("a"), F.explode("forms").alias("fa")).join(df.select("doc_id", F.col("id").alias("b"), F.explode("forms").alias("fb")), "doc_id")
    from factloom.functions import text as T

    whole = pairs.withColumn("s", fuzzy.name_similarity(T.norm_name(F.col("fa")), T.norm_name(F.col("fb")), T.core_name(F.col("fa")), T.core_name(F.col("fb")))).where("s > 0").groupBy("a", "b").agg(F.max("s").alias("s"))
    want = {(r.a, r.b): round(r.s, 9) for r in whole.collect()}
    assert {(r.a, r.b): round(r.s, 9) for r in metrics.name_pairs(df, df).collect()} == want


def _best(w):
    """Largest total of a matching, by trying every partner of every row."""
    if not len(w):
        return 0.0
    return max([_best(w[1:])] + [w[0, j] + _best(np.delete(w[1:], j, axis=1)) for j in range(w.shape[1]) if w[0, j] > 0])


def test_sparse_assignment_against_all_matchings():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, m = rng.integers(1, 6, 2)
        w = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.6), rng.integers(1, 4))
        got = metrics.assign([(i, j, w[i, j]) for i in range(n) for j in range(m) if w[i, j] > 0])
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert sum(w[i, j] for i, j in got) == pytest.approx(_best(w))


def test_large_documents_are_solved_in_components(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{d}", f"g{d}.{b}.{i}", f"p{d}.{b}.{j}", round(float(rng.random()) + 0.01, 3)) for d in range(3) for b in range(8) for i in range(4) for j in range(4) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "doc_id string, gold_id string, pred_id string, score double").repartition(3)
    small, large = (metrics.align(df, large=n).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("w"), F.count(F.lit(1)).alias("n"), F.countDistinct("gold_id").alias("g"), F.countDistinct("pred_id").alias("p")).collect() for n in (10**6, 5))
    assert sorted(small) == sorted(large) and all(r.n == r.g == r.p for r in large)
    for d in range(3):
        total = 0.0
        for b in range(8):
            w = np.zeros((4, 4))
            for doc, g, p, s in rows:
                if doc == f"d{d}" and g.startswith(f"g{d}.{b}."):
                    w[int(g[-1]), int(p[-1])] = s
            total += _best(w)
        assert next(r.w for r in small if r.doc_id == f"d{d}") == pytest.approx(total)


def test_cooccurrence_against_all_pairs(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["x", "y", ". "]) for _ in range(4_000))
    cites = [("d", rng.choice("abc"), pos, s, s + rng.choice([0, 3, 30, 500])) for pos, s in enumerate(rng.randint(0, 3_000) for _ in range(150))]
    cites += [("d", e, 1_000 + i, 77, 80) for i, e in enumerate("aabbc")]
    pairs = [("d", x, y) for x in "abc" for y in "abc"]
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    frame = spark.createDataFrame(cites, "doc_id string, entity_id string, pos int, start_char int, end_char int")
    got = {(r.source, r.target): (r.start_char, r.end_char) for r in anchor.cooccurrence(spark.createDataFrame(pairs, "doc_id string, source string, target string"), frame, docs).collect()}
    want = {}
    for _, x, y in pairs:
        found = [(max(a[4], b[4]) - min(a[3], b[3]), a[2], b[2], min(a[3], b[3]), max(a[4], b[4])) for a in cites for b in cites if a[1] == x and b[1] == y and a[4] > a[3] and b[4] > b[3]]
        width, _, _, lo, hi = min(found)
        if width <= 400:
            before, after = text.rfind(". ", 0, lo), text.find(". ", hi)
            want[x, y] = (max(before + 2 if before >= 0 else 0, lo - 200), min(after + 1 if after >= 0 else len(text), hi + 200))
    assert got == want


def _plain_fold(mentions):
    """Every cluster and every form asked in order."""
    out = []
    for i, (name, valid) in enumerate(mentions):
        if not valid:
            continue
        for c in out:
            if 2 <= len(name) <= 6 and name.upper() == resolve.initials(c["name"]):
                c["aliases"].append(name)
                c["mentions"].append(i)
                break
            a = resolve.fold_key(name)
            if any((100.0 if not a and not b else 200.0 * fuzzy.lcs(a, b) / (len(a) + len(b))) > 90 for b in map(resolve.fold_key, [c["name"], *c["aliases"]])):
                if name != c["name"] and name not in c["aliases"]:
                    c["aliases"].append(name)
                c["mentions"].append(i)
                break
        else:
            out.append({"name": name, "aliases": [], "mentions": [i]})
    return out


def _mentions(rng, n):
    names = [" ".join(s.capitalize() for s in rng.sample(["alpha", "beta", "betta", "gamma", "gama", "delta", "of", "the"], rng.randint(1, 4))) for _ in range(12)] + ["ABG", "BD", "ag", "...", "-"]
    return [(n[: len(n) - 1] + rng.choice("xyz") if rng.random() < 0.3 else n, rng.random() < 0.9) for n in (rng.choice(names) for _ in range(n))]


def test_indexed_fold_equals_the_plain_one():
    for seed in range(60):
        mentions = _mentions(random.Random(seed), 60)
        want = _plain_fold(mentions)
        got = resolve.greedy_fold([(n, "t", v) for n, v in mentions])
        assert [(c["name"], c["aliases"], c["mentions"]) for c in got] == [(c["name"], c["aliases"], c["mentions"]) for c in want]


def test_index_compares_few_forms():
    rng = random.Random(0)
    seen = resolve.Seen()
    for i in range(500):
        key = _word(rng, 15, 25, "abcdefghijklmnopqrstuvwxyz")
        assert seen.first(key) is None
        seen.add(key, i)
    assert seen.compared < 500


def test_large_documents_are_folded_in_parts(spark):
    rows = [(f"d{d}", pos, n, "t", v) for d in range(3) for pos, (n, v) in enumerate(_mentions(random.Random(d), 80))]
    df = spark.createDataFrame(rows, "doc_id string, pos int, name string, type string, is_valid boolean").repartition(3)
    whole, parts = (sorted(map(str, resolve.greedy_clusters(df, large=n).collect())) for n in (10**6, 50))
    assert whole == parts
    for d in range(3):
        mine = _plain_fold([(n, v) for doc, _, n, _, v in rows if doc == f"d{d}"])
        got = {r.entity_id: (r.canonical_name, list(r.aliases), r.mentions) for r in resolve.greedy_clusters(df).where(F.col("doc_id") == f"d{d}").collect()}
        assert got == {f"E{i}": (c["name"], c["aliases"], len(c["mentions"])) for i, c in enumerate(mine)}


def test_whole_groups_at_any_batching():
    rng = random.Random(4)
    for _ in range(50):
        keys = sorted(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))
        rows = pd.DataFrame({"k": keys, "v": range(len(keys))})
        cuts = sorted(rng.randint(0, len(keys)) for _ in range(rng.randint(0, 8)))
        frames = [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True)]
        got = list(grouped.whole_groups(iter(frames), ["k"]))
        assert [v for f in got for v in f["v"]] == list(range(len(keys)))
        assert sum(f["k"].nunique() for f in got) == len(set(keys))
