"""Hand-computed cases of names, chunks, anchors and definitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.functions import text as T
from factloom.operators import anchor, chunk, resolve


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*(F.col(f"c{i}") for i in range(len(values)))).alias("v")).first().v


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (T.normalize_entity_name, "Acme-Tools,  Inc.", "acme tools"),
        (T.normalize_entity_name, "Ltd.", ""),
        (T.norm_key, "Straße 12-B", "strasse12b"),
        (T.norm_name, "Ｆｕｌｌ Wıdth, ﬁn", "fullwıdthfin"),
        (T.core_name, "The Acme (UK) Corp. of Bonn", "acme bonn"),
        (T.core_name, "The Company", "the company"),
        (T.alias_key, "The ABC GmbH & Co. KG", "abc"),
        (T.alias_key, "GmbH", "gmbh"),
        (T.alias_key, "Sport e. V.", "sport"),
        (T.alias_key, None, ""),
        (T.norm_type, " Organisation ", "company"),
        (T.norm_type, "regulator", "other"),
        (T.norm_rel, "Owned - by", "owned_by"),
        (T.clean_id, " [E1] ", "E1"),
        (T.detok, "Acme ( UK ) Inc .", "Acme (UK) Inc."),
        (T.mask, "secret", "[redacted 6 chars]"),
        (T.mask, None, None),
    ],
)
def test_names(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize(("name", "junk"), [("$1,000", True), ("USD 5.5", True), ("Section 4 of", True), ("key personnel", True), ("Ltd.", True), ("Acme", False), ("Sectional 4", False)])
def test_junk(spark, name, junk):
    assert one(spark, T.is_junk, name) is junk


@pytest.mark.parametrize(("short", "long", "want"), [("FDA", "Food and Drug Administration", True), ("fda", "Food and Drug Administration", True), ("F", "Food", False), ("FADA", "Food and Drug Administration", False)])
def test_acronym(spark, short, long, want):
    assert one(spark, T.is_acronym, short, long) is want


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.lcs(a, b) == table[-1][-1]
    assert fuzzy.lcs("kitten", "sitting") == 4


def test_length_bound_loses_nothing(spark):
    rng = random.Random(2)
    rows = [("a" * rng.randint(0, 30), "a" * rng.randint(0, 30)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select(fuzzy.ratio(F.col("a"), F.col("b")).alias("r"), fuzzy.lengths_allow(F.col("a"), F.col("b"), 0.9).alias("ok"))
    assert df.where("r >= 90 and not ok").count() == 0


def test_sentence_chunks():
    assert chunk.pack_sentences("One. Two! Three?", 2000) == ["One. Two! Three?"]
    made = chunk.pack_sentences("Aaaa bbbb. Cccc dddd. Eeee ffff.", 24, 12)
    assert made[0] == "Aaaa bbbb. Cccc dddd." and made[1].endswith("Eeee ffff.")
    long = "x" * 50 + ". Tail."
    assert chunk.pack_sentences(long, 20)[0] == "x" * 50 + "." and chunk.pack_sentences(long, 20, keep_empty=True)[0] == ""
    assert chunk.pack_sentences("") == []


def test_paragraph_chunks():
    assert chunk.pack_paragraphs("a\n\nb\nc", 3) == ["a\nb", "c"]
    assert chunk.pack_paragraphs("a" * 10 + "\nb", 5) == ["a" * 10, "b"]
    assert chunk.pack_paragraphs("\n\n") == []


def test_chunks_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word. " * 20_000)], "doc_id long, text string")
    rows = chunk.chunks(df, "sentences").collect()
    assert {r.doc_id for r in rows} == {3} and all(len(r.text) < 2600 for r in rows) and [r.chunk_id for r in rows] == list(range(len(rows)))
    with pytest.raises(ValueError, match="other"):
        chunk.chunks(df, "other")


def test_span_decoding(spark):
    tags = ["B-PER", "I-PER", "O", "I-ORG", "I-ORG", "I-PER", "B-PER", "", "B-ORG"]
    df = spark.createDataFrame([("d", 0, i, t) for i, t in enumerate(tags)], "doc_id string, sent int, pos int, tag string")
    got = sorted(map(tuple, chunk.decode_spans(df).select("label", "first", "last").collect()))
    assert got == [("ORG", 3, 4), ("ORG", 8, 8), ("PER", 0, 1), ("PER", 5, 5), ("PER", 6, 6)]


def _anchored(spark, ref, chunk_text, lo, hi):
    df = spark.createDataFrame([(ref, chunk_text, lo, hi)], "ref string, chunk_text string, span_start int, span_end int")
    row = anchor.anchor_spans(df).first()
    return row and (row.start_char, row.end_char, row.quote, row.match)


def test_anchor_tiers(spark):
    ref = "Intro. Acme signed. Later Acme paid in full."
    assert _anchored(spark, ref, ref, 26, 30) == (26, 30, "Acme", "verbatim")
    assert _anchored(spark, ref, anchor.CDATA + ref, 26 + len(anchor.CDATA), 30 + len(anchor.CDATA)) == (26, 30, "Acme", "verbatim")
    assert _anchored(spark, ref, "elsewhere Acme", 10, 14) == (7, 11, "Acme", "verbatim")
    assert _anchored(spark, "a  Acme\n Corp b", "Acme Corp", 0, 9) == (3, 13, "Acme\n Corp", "verbatim")
    assert _anchored(spark, ref, "Zeta Ltd", 0, 8) == (0, 0, "Zeta Ltd", "unanchored")
    assert _anchored(spark, ref, "x   y", 1, 3) is None


def test_alnum_location():
    text = "Urteil vom 11 . 2 . 2015, die Straße ist lang genug"
    assert anchor.alnum_locate(text, "vom 11 . 2") == (7, 17)
    lo, hi = anchor.alnum_locate(text, "vom 11.2.2015, die Strasse")
    assert text[lo:hi] == "vom 11 . 2 . 2015, die Straße"
    assert anchor.alnum_locate(text, "11.2.2015") is None and anchor.alnum_locate(text, " ") is None


def test_anchored_slices_equal_their_quotes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("char_length(text) > 150")
    rows = docs.select("doc_id", "text", F.expr("substring(text, doc_id % 90 + 1, 40)").alias("q"))
    found = anchor.locate_quotes(rows, "text", "q").where("start_char is not null")
    assert found.count() > 50 and found.where("substring(text, start_char + 1, end_char - start_char) <> quote").count() == 0


def test_definitions():
    text = 'between Aurora Holdings GmbH (nachfolgend "Aurora") and New Name AG (vormals Old Name GmbH), Acme Inc. (hereinafter the "Company").'
    assert [x[1:] for x in resolve.definitions(text)] == [("Aurora Holdings GmbH", "Aurora"), ("New Name AG", "Old Name GmbH")]


def test_definitions_of_made_up_texts(spark):
    """Texts put together from parts whose definitions are known, through the function and through SQL."""
    rng = random.Random(3)
    names, shorts = ["Aurora Holdings GmbH", "Zeta AG", "Dana Cole", "Bank of Ulm"], ["AH", "Zeta", "the Tenant", "D.C."]
    texts, want = [], []
    for i in range(60):
        parts, at = [], 0
        for _ in range(rng.randint(0, 4)):
            name, short, lead = rng.choice(names), rng.choice(shorts), rng.choice(["hereinafter", "nachfolgend", ""])
            kind = rng.randrange(3)
            begin = f"and so {name} "
            inner = (f'({lead} "{short}")' if lead else f'("{short}")') if kind == 0 else f"(formerly {rng.choice(names)})" if kind == 1 else "(see below)"
            if kind == 0:
                want.append((i, at + len(begin), name, short))
            elif kind == 1:
                want.append((i, at + len(begin), name, inner[10:-1]))
            parts.append(f"{begin}{inner} came; ")
            at += len(parts[-1])
        texts.append((i, "".join(parts)))
    docs = spark.createDataFrame([*texts, (98, None), (99, "")], "doc_id int, text string")
    assert sorted(map(tuple, resolve.defined_terms(docs).collect())) == sorted(want)
    docs.createOrReplaceTempView("texts")
    rows = spark.sql("SELECT doc_id, t.* FROM texts, LATERAL definitions(text, 12) t")
    assert rows.columns == ["doc_id", "pos", "name", "alias", "context"]
    whole = dict(texts)
    assert sorted(map(tuple, rows.collect())) == sorted((i, p, n, a, whole[i][max(0, p - 12) : p + 12]) for i, p, n, a in want)


def test_definitions_do_not_merge_owned_keys(spark):
    from factloom.operators import convert

    ents = spark.createDataFrame([("d", "E1", 0, "Aurora Holdings GmbH", "company", []), ("d", "E2", 1, "Zeta AG", "company", [])], "doc_id string, entity_id string, pos long, canonical_name string, entity_type string, aliases array<string>")
    docs = spark.createDataFrame([("d", 'Aurora Holdings GmbH (hereinafter "AH") and Aurora Holdings GmbH (hereinafter "Zeta").')], "doc_id string, text string")
    assert {r.entity_id: r.aliases for r in convert.alias_pass(ents, docs).collect()} == {"E1": ["AH"], "E2": []}


def test_greedy_fold_is_order_dependent_and_ignores_types():
    m = [("Acme Corp", "company", True), ("ACME", "person", True), ("Food and Drug Administration", "company", True), ("FDA", "company", True), ("Bad", "company", False)]
    got = resolve.greedy_fold(m)
    assert [(c["name"], c["aliases"], len(c["mentions"])) for c in got] == [("Acme Corp", ["ACME"], 2), ("Food and Drug Administration", ["FDA"], 2)]
    assert len(resolve.greedy_fold(m, keep_acronym_citation=False)[1]["mentions"]) == 1


def test_resolution_does_not_depend_on_row_order(spark):
    rows = [("d", f"E{i}", i, n, t, a) for i, (n, t, a) in enumerate([("Acme GmbH", "company", []), ("ACME", "other", []), ("Acme", "person", ["AC"]), ("AC", "company", []), ("Bolt LLC", "asset", []), ("Bolt", "agreement", [])])]
    schema = "doc_id string, entity_id string, pos long, canonical_name string, entity_type string, aliases array<string>"
    results = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = resolve.resolve(spark.createDataFrame(rows, schema).repartition(1 + seed * 3))
        results.append(sorted((r.comp, r.canonical_name, r.entity_type, tuple(r.aliases), r.members) for r in got.collect()))
    assert results[0] == results[1] and [r[4] for r in results[0]] == [4, 1, 1] and results[0][0][1:3] == ("Acme GmbH", "company")


def test_unique_containment(spark):
    forms = spark.createDataFrame([("d", "Microsoft Corporation", "E1", 0), ("d", "Acme East", "E2", 1), ("d", "Acme West", "E3", 2)], "doc_id string, form string, entity_id string, pos int")
    names = spark.createDataFrame([("d", "Microsoft"), ("d", "Acme"), ("d", "acme-west"), ("d", "MS")], "doc_id string, name string")
    assert {r.name: r.entity_id for r in resolve.match_name(names, forms).collect()} == {"Microsoft": "E1", "Acme": None, "acme-west": "E3", "MS": None}


def test_quotes_of_all_lengths_are_found(spark):
    texts = ["one two three four five six", "xone two three four fivey", "a", "", None, "b  c", "two three", "one two three four five six " * 500 + "z"]
    quotes = ["one two three four five", "two three", "a", "b ", "ve", " ", "", "three four five six one two", "e f", "not there at all anywhere"]
    docs, qs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "item_id long, q string")
    got = {(r.doc_id, r.item_id): r.start_char for r in anchor.quotes_in(docs, qs).collect()}
    assert got == {(i, j): t.find(q) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and q in t}
