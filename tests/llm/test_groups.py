"""Near duplicates, lines, shards, fingerprints and packing."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import fingerprint, line_dedup, near_dedup, packing, sharding


def _near(docs, n=4, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    comp = {d: d for d, _ in docs}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, _) in enumerate(docs):
        for j, (b, _) in enumerate(docs[:i]):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for (d, _), s in zip(docs, sets, strict=True))


def _copies(seed, groups, size, words=60, edits=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    docs = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, words))
        for _ in range(size):
            text = list(base)
            for p in rng.integers(0, words, rng.integers(0, edits)):
                text[p] = str(rng.choice(vocabulary))
            docs.append(" ".join(text))
    ids = rng.permutation(len(docs) * 3)[: len(docs)]
    return [(int(i), t) for i, t in zip(ids, docs, strict=True)]


@pytest.mark.parametrize(("groups", "size"), [(8, 6), (1, 90)])
def test_components_against_brute_force(spark, groups, size):
    docs = _copies(groups, groups, size) + [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "ONE  two"), (10_004, "x " * 30_000)]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, rep int").repartition(3)
    got = near_dedup.components(df, shingle=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _near(docs)
    kept = near_dedup.keep(df, shingle=4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in _near(docs)})


def test_large_buckets_lose_no_link(spark, monkeypatch):
    docs = _copies(77, 1, 150, words=80, edits=14)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = near_dedup._across
    for few, rare in ((3, 2), (3, 40), (1000, 32)):
        monkeypatch.setattr(near_dedup, "_across", lambda *a, few=few, rare=rare: whole(*a, few=few, rare=rare))
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(df, shingle=4).collect()) == _near(docs)


def test_near_dedup_keeps_one_row_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a, "x"), (1, a, "y"), (2, a + " more", "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (4, None, "x"), (4, None, "x"), (5, b, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = near_dedup.keep(df, shingle=4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in kept.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, ""), (4, "")]


def test_near_dedup_of_an_id_with_two_texts(spark):
    own, copy = "own " * 3 + "words of five", " ".join(f"c{i}" for i in range(40))
    df = spark.createDataFrame([(5, own, 1), (5, copy, 2), (3, copy, 3)], "doc_id long, text string, uid int").selectExpr("*", "'x' AS doc")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(df, shingle=4).collect()) == [(3, 3, True), (5, 3, False), (5, 5, True)]
    kept = near_dedup.keep(df, shingle=4)
    assert kept.columns == df.columns and sorted((r.doc_id, r.uid) for r in kept.collect()) == [(3, 3), (5, 1)]


def test_pairs_at_the_threshold_are_found(spark):
    """300 pairs of similarity 0.8 to 0.83, and 300 just below: recall and precision."""
    rng = np.random.default_rng(6)
    docs, want = [], {}
    for i in range(600):
        words = [f"{i}w{j}" for j in range(int(rng.integers(60, 200)))]
        n = len(words) - 3
        kept = 0
        while True:  # a changed last word costs one shingle on each side
            kept += 1
            if 100 * (n - kept) < 80 * (n + kept):
                break
        change = kept - 1 if i < 300 else kept
        other = [*words[: len(words) - change], *(f"x{i}y{j}" for j in range(change))]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        want[2 * i + 1] = 2 * i if i < 300 else 2 * i + 1
    got = {r.doc_id: r.component_id for r in near_dedup.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle=4).collect()}
    assert {d: got[d] for d in want} == want


def test_near_dedup_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(r.component_id for r in near_dedup.components(df).collect()) == [1, 1, 1]
    assert near_dedup.components(df.limit(0)).count() == 0


def test_components_from_many_tasks(spark):
    rng = np.random.default_rng(9)
    chain = list(rng.permutation(200))
    edges = [(int(a), int(b)) for i, (a, b) in enumerate(zip(chain[:-1], chain[1:], strict=True)) if i % 50 != 49]
    want = {}
    for i in range(0, 200, 50):
        want.update((int(v), int(min(chain[i : i + 50]))) for v in chain[i : i + 50])
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    for per in (10, 40, 60, 1000):
        assert {r.id: r.comp for r in near_dedup.label_components(df, per).collect()} == want
    assert near_dedup.label_components(df.limit(0)).count() == 0


def test_least_matches_is_monotone_and_safe():
    found = [near_dedup.least_matches(n, 0.8, 1e-7) for n in (40, 80, 120, 160, 200)]
    assert found == sorted(found) and 0 < found[0] < 0.8 * 40


def _lines(docs, depth=2, fields=3):
    """Lines that go, from all pairs of lines and seeds."""
    of, seen = {}, {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if sum(x != "<*>" for x in w) >= 3:
                of[d, i] = w
                seen.setdefault(w, []).append((d, i))
    docs_of = {w: {d for d, _ in at} for w, at in seen.items()}
    differ = lambda n: min(fields, n // 5)
    least = lambda w: 2 if sum(x != "<*>" for x in w) > 50 else 5
    buckets = collections.defaultdict(list)
    for w in seen:
        n, k = len(w), differ(len(w))
        for j in range(k + 1 if k else 0):
            lo, hi = depth + (n - depth) * j // (k + 1), depth + (n - depth) * (j + 1) // (k + 1)
            buckets[n, w[:depth], j, w[lo:hi]].append(w)
    groups = [({w}, least(w)) for w in seen]
    made = collections.defaultdict(set)
    for (n, *_), ws in buckets.items():
        if len(ws) > 1:
            seed = min(ws, key=lambda w: (-len(docs_of[w]), min(seen[w])))
            made[seed].update(w for w in ws if w != seed and sum(x != y for x, y in zip(w, seed, strict=True)) <= differ(n))
    groups += [({seed, *ws}, least(seed)) for seed, ws in made.items() if ws]
    gone = set()
    for g, enough in groups:
        among = set().union(*(docs_of[w] for w in g))
        if len(among) >= enough:
            gone |= {(d, i) for w in g for d, i in seen[w] if d != min(among)}
    return gone


def _line_docs():
    rng = np.random.default_rng(4)
    long = [f"t{chr(97 + i)}" for i in range(18)]
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    docs = []
    for i in range(40):
        one, two, three = list(long), ["dear", "friend", *long[:9]], ["pay", "to", "name", "by", "card"]
        one[int(rng.integers(9, 18))] = f"v{chr(97 + i % 26)}"
        for p in rng.integers(2, 11, 2):
            two[p] = f"u{chr(97 + int(rng.integers(26)))}"
        three[2 + int(rng.integers(0, 2))] = f"n{chr(97 + i % 26)}"
        lines = [f"Order {i} shipped on 2024-01-{i:02d}", " ".join(one), " ".join(two), " ".join(three), f"only here {'x' * (i + 1)}", "", "two words", "1 22 3", " ".join(str(i + k) for k in range(60))]
        if i in (3, 30):
            lines.append(passage)
        if i == 31:
            lines.append(passage.replace("pab", "other"))
        docs.append((i, "\n".join(lines[k] for k in rng.permutation(len(lines))[: rng.integers(1, 8)])))
    return docs + [(90, None), (91, ""), (92, "\n\n"), (93, "word " * 40_000)]


def test_lines_alike_share_a_template_and_passages_go_from_two():
    docs = [(i, f"pay to n{chr(97 + i)} by card") for i in range(6)] + [(7 + i, " ".join([f"w{chr(97 + k % 26)}{'z' * (k // 26)}" for k in range(55)])) for i in range(2)] + [(20 + i, " ".join(f"{i}n{k}" for k in range(60))) for i in range(9)]
    assert _lines(docs) == {(i, 0) for i in range(1, 6)} | {(8, 0)}


def test_line_templates_against_brute_force(spark):
    docs = _line_docs()
    df = spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in docs], "doc_id long, text string, n_chars long, line string").repartition(3)
    gone = _lines(docs)
    assert len({d for d, _ in gone}) > 25
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text_sha256) for r in line_dedup.report(df).collect()}
    for d, t in docs:
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone]
        n = 0 if t is None else len(t.split("\n"))
        assert got[d] == (n, n - (0 if t is None else len(kept)), hashlib.sha256("\n".join(kept).encode()).hexdigest()), d
    small = {r.doc_id: r.n_dropped for r in line_dedup.report(df, most_bits=1).collect()}
    assert small == {d: x[1] for d, x in got.items()}
    clean = line_dedup.clean(df)
    assert clean.schema == df.schema and clean.where("n_chars <> char_length(text)").count() == 0 and {90, 91, 92, 93} <= {r.doc_id for r in clean.select("doc_id").collect()}
    assert line_dedup.report(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_and_null_ids_and_clashing_names(spark):
    line = "the very same line here"
    rows = [(1, line, "a"), (1, line, "a"), (1, f"{line}\nx", "b"), (2, line, "c"), (None, line, "d"), (3, f"{line}\ny", "e"), (4, f"z\n{line}", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").selectExpr("*", "'own' AS gone")
    kept = line_dedup.clean(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, line), (1, line), (1, f"{line}\nx"), (None, line), (3, "y"), (4, "z")], key=str)


def test_shards_are_even_and_keep_small_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 50 == 0 else f"t{i // 2 if i % 5 else 0} " + "y" * int(rng.integers(0, 200)) * (i % 5 != 0), "k") for i in range(3000)] + [(7, "dup", "k"), (7, "dup", "k")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(40))
    by = got.groupby("shard").agg(size=("size", "sum"), n=("slot", "size"), lo=("slot", "min"), hi=("slot", "max"), distinct=("slot", "nunique"))
    assert (by["lo"] == 0).all() and (by["hi"] + 1 == by["n"]).all() and (by["distinct"] == by["n"]).all()
    assert by["size"].max() < 1.1 * by["size"].mean() and by["size"].min() > 0.9 * by["size"].mean()
    texts = {i: t or "" for i, t, _ in rows}
    assert all(s == len(texts[i].encode()) + 16 for i, s in zip(got["doc_id"], got["size"], strict=True) if i != 7)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overfull_ranges_are_subdivided(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select("id", F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 3 == 0, F.lit(5 << 32).bitwiseOR(F.col("id"))).otherwise(F.shiftleft("id", 32)).alias("key"))
    got = sharding.shard(rows, 8, group_mask=-(1 << 32), ranges_per_shard=4).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 1.1 * 500


def _sketched(t):
    w = re.split("[ \t-\r]+", t.lower().strip(" \t\n\x0b\x0c\r")) if t.strip(" \t\n\x0b\x0c\r") else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_fingerprints_against_brute_force(spark, monkeypatch, n):
    whole = fingerprint.with_successor
    monkeypatch.setattr(fingerprint, "with_successor", lambda *a, **k: whole(*a, **{**k, "range_bytes": 40}))
    rng = np.random.default_rng(0)
    docs = [(int(i), None if i % 7 == 0 else f"w{i} é x y z q " * int(i % 5)) for i in rng.integers(-50, 50, 60)][:n]
    got = fingerprint.fingerprints(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, next int").repartition(3)).collect()
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (-r[0], r[1]))
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    expected = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(_sketched(t), _sketched(edited)), 9), round(like(_sketched(t), _sketched(after)), 9)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(expected)


def test_fingerprints_of_null_ids(spark):
    for rows, follows in (([(2, "a"), (None, "b"), (1, "c")], {"a": "c", "c": "b", "b": "a"}), ([(None, "x"), (None, "y")], {"x": "y", "y": "x"})):
        found = fingerprint.with_successor(spark.createDataFrame(rows, "id long, text string"), "id", "text", ["text"])
        assert {r.text: r.next.text for r in found.collect()} == follows


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(4000)]
    rng.shuffle(words)
    df = spark.createDataFrame([(" ".join(words), " ".join(words[1000:]))], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("j"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.containment(F.col("b"), F.col("a")).alias("c"), (fingerprint.merge(F.col("a"), F.col("b")) == F.col("a")).alias("same")).first()
    assert abs(r.j - 0.75) < 0.15 and abs(r.n - 3996) < 1200 and r.c > 0.85 and r.same


def test_packing_covers_every_token():
    rng = np.random.default_rng(0)
    for trial in range(300):
        lengths = [int(rng.integers(1, 100 if rng.random() < 0.5 else 20)) for _ in range(int(rng.integers(0, 40)))]
        slack = int(rng.integers(0, 5))
        pieces = collections.defaultdict(list)
        padded = 0
        for seq in packing.pack_lengths(lengths, 16, slack):
            total = sum(p[2] for p in seq)
            assert 0 < total <= 16
            padded += 0 if total & (total - 1) == 0 else 16 - total
            for d, at, n in seq:
                pieces[d].append((at, n))
        for d, n in enumerate(lengths):
            at = 0
            for a, k in sorted(pieces[d]):
                assert a == at and k > 0
                at += k
            assert at == n, trial


def test_tightest_window_is_found():
    rng = np.random.default_rng(5)
    tree, rooms = packing.CapacityTree(64), []
    for i in range(400):
        need = int(rng.integers(0, 65))
        assert tree.tightest(need) == min((r for r in rooms if r >= need), default=None)
        if rooms and rng.random() < 0.4:
            room = rooms.pop(int(rng.integers(len(rooms))))
            tree.take(room)
        else:
            rooms.append(int(rng.integers(0, 65)))
            tree.add(rooms[-1], i)


def test_packed_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "foo<|endoftext|>bar, x", "don't 'sfoo abc's d'll e_f 12a é### ß*** ABC### ΣΑΣ.\x1cb", "Hello, World! " * 9000, "same", "same"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = collections.defaultdict(bytes)
    places = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start * 4 == len(found[r.doc_id])
        found[r.doc_id] += bytes(r.ids)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(found[i], "<u4").tolist() == ids
        assert {r.doc_tokens for r in rows if r.doc_id == i} == {len(ids)}
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(df.limit(0)).count() == 0


def test_word_table_forgets_and_relearns():
    import public_tokenizers

    table = packing.WordTable(public_tokenizers.path("word_bpe_49k.json"), most=5)
    texts = pa.array([f"alpha{i} beta{i}, gamma" for i in range(30)])
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [x.tolist() for x in table.encode(texts, block_bytes=60)] == want and [x.tolist() for x in table.encode(texts, block_bytes=60)] == want
