"""Hand-computed metrics."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import schema as S
from factloom.operators import anchor, graph, metrics, ops, passes

ENT = "doc_id string, id string, name string, type string, aliases array<string>, forms array<string>"


def ents(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, i, n, t, list(a), [n, *a]) for i, n, t, *rest in rows for a in [rest[0] if rest else []]], ENT)


def counts(spark, gold, pred, strict, types=None):
    scope = None if types is None else spark.createDataFrame([("d", types)], "doc_id string, types array<string>")
    aligned = metrics.align(metrics.similarities(gold, pred))
    return metrics.entity_counts(gold, pred, aligned, strict, scope)


def test_strict_and_lenient(spark):
    gold = ents(spark, [("g1", "Acme Corp", "company"), ("g2", "Bolt LLC", "company"), ("g3", "Carol Diaz", "person"), ("g4", "Delta AG", "company")])
    pred = ents(spark, [("p1", "Acme Corporation", "company"), ("p2", "Bolt LLC", "person"), ("p3", "Carol Diaz", "person"), ("p4", "Echo Inc", "company")])
    row = counts(spark, gold, pred, True).first()
    assert (row.tp, row.fp, row.fn) == (2, 2, 2)
    total = metrics.summarise(counts(spark, gold, pred, False)).first()
    assert (total.tp, total.fp, total.fn, total.precision, total.recall, total.f1) == (3, 1, 1, 0.75, 0.75, 0.75)


def test_alignment_is_one_to_one(spark):
    rows = [("1", "Acme Corp", "company"), ("2", "Acme Corp Holdings", "company")]
    for order in (rows, rows[::-1]):
        got = metrics.align(metrics.similarities(ents(spark, rows), ents(spark, order))).collect()
        assert {(r.gold_id, r.pred_id) for r in got} == {("1", "1"), ("2", "2")}


def test_partial_labels_leave_precision_undefined(spark):
    gold, pred = ents(spark, [("g", "Acme Corp", "company")]), ents(spark, [("p", "Acme Corp", "company"), ("q", "Somebody Else", "person")])
    total = metrics.summarise(counts(spark, gold, pred, False, [])).first()
    assert total.recall == 1.0 and total.precision is None and total.f1 is None


def test_other_types_are_no_false_positives(spark):
    gold, pred = ents(spark, [("g", "Acme Corp", "company")]), ents(spark, [("p", "Acme Corp", "company"), ("q", "Munich", "other"), ("r", "Zeta Ltd", "company")])
    row = counts(spark, gold, pred, False, ["company"]).first()
    assert (row.tp, row.fp) == (1, 1)


def test_missing_prediction_is_all_missed(spark):
    gold = ents(spark, [("g", "Acme", "company")])
    row = counts(spark, gold, gold.limit(0), False).first()
    assert (row.tp, row.fp, row.fn) == (0, 0, 1)


def test_alias_recall(spark):
    gold = ents(spark, [("g", "Aurora Strategic Holdings, Inc.", "company", ["Aurora", "ASH"])])
    pred = ents(spark, [("p", "Aurora Strategic Holdings", "company", ["Aurora"])])
    row = metrics.alias_recall(gold, pred, metrics.align(metrics.similarities(gold, pred))).first()
    assert (row.covered, row.total) == (1, 2)


def test_relation_levels(spark):
    schema = "doc_id string, source string, relation string, target string"
    gold = spark.createDataFrame([("d", "a", "controls", "b"), ("d", "c", "represents", "a"), ("d", "d", "controls", "a")], schema)
    raw = spark.createDataFrame([("d", "1", "controls", "2"), ("d", "3", "related_to", "1"), ("d", "2", "controls", "1")], schema)
    aligned = spark.createDataFrame([("d", "a", "1", 1.0), ("d", "b", "2", 1.0), ("d", "c", "3", 1.0)], "doc_id string, gold_id string, pred_id string, score double")
    pred = metrics.mapped_relations(raw, aligned)
    got = {level: tuple(metrics.relation_counts(gold, pred, level).select("tp", "fp", "fn").first()) for level in metrics.LEVELS}
    assert got["strict"] == (1, 2, 2) and got["undirected"] == (1, 1, 2) and got["untyped"][0] == got["pair"][0] == 2


def _clusters(spark, gold, pred):
    make = lambda cs: spark.createDataFrame([("d", x, f"c{i}") for i, c in enumerate(cs) for x in c], "doc_id string, item string, cluster string")
    return make(gold), make(pred)


def test_coreference(spark):
    over = metrics.cluster_scores(metrics.cluster_counts(*_clusters(spark, [["a", "b"], ["c", "d"]], [["a", "b", "c", "d"]]))).first()
    assert over.pair_recall == 1.0 and over.pair_precision == pytest.approx(2 / 6) and over.b3_precision == 0.5 and over.b3_recall == 1.0
    under = metrics.cluster_scores(metrics.cluster_counts(*_clusters(spark, [["a", "b"]], [["a"], ["b"]]))).first()
    assert under.pair_recall == 0.0 and under.b3_recall == 0.5
    same = metrics.cluster_scores(metrics.cluster_counts(*_clusters(spark, [["a", "b"], ["c"]], [["a", "b"], ["c"]]))).first()
    assert {v for k, v in same.asDict().items() if k != "doc_id"} == {1.0}
    nothing = metrics.cluster_scores(metrics.cluster_counts(*_clusters(spark, [["a"], ["b"]], [["a"], ["b"]]))).first()
    assert nothing.pair_recall is None and nothing.muc_recall is None
    assert tuple(metrics.ceaf_e(*_clusters(spark, [["a", "b"], ["c"]], [["a", "b"], ["c"]])).first())[1:] == (1.0, 1.0)


def test_provenance(spark):
    docs = spark.createDataFrame([("d", "Acme Corp. signed the   Master Agreement with Bolt LLC.")], "doc_id string, text string")
    quotes = spark.createDataFrame([("d", "1", "Acme Corp. signed the Master Agreement"), ("d", "1", "#/texts/0"), ("d", "2", "Totally Invented Ltd paid")], "doc_id string, entity_id string, quote string")
    names = spark.createDataFrame([("d", "1", "Acme Corp"), ("d", "2", "Totally Invented Ltd")], "doc_id string, entity_id string, name string")
    r = metrics.provenance(quotes, names, docs).first()
    assert (r.quotes, r.verbatim, r.placeholder, r.entities, r.unsupported) == (3, 1, 1, 2, 1)


def test_intrinsic(spark):
    e = spark.createDataFrame([("d", "c1", "Northbridge Risk Holdings", "company"), ("d", "c2", "Northbridge Risk Holdings", "person"), ("d", "a1", "Master Agreement", "agreement"), ("d", "x", "Lonely", "company")], "doc_id string, entity_id string, name string, type string")
    r = spark.createDataFrame([("d", "a1", "controls", "c1"), ("d", "c1", "participates_in", "a1"), ("d", "c1", "owns", "ghost")], "doc_id string, source string, relation string, target string")
    got = metrics.intrinsic(e, r, S.rules_table(spark), S.RELATION_TYPES).first()
    assert (got.duplicate_entity_groups, got.type_conflict_names) == (1, 1)
    assert got.direction_violation_rate == got.dangling_relation_rate == got.unknown_relation_type_rate == pytest.approx(1 / 3) and got.orphan_entity_rate == 0.5


def test_taxonomy_and_sensitivity(spark):
    text = "K. Beschluss der Markenstelle fuer Klasse 2 § 24 Abs. 4 Vertrag Koch Acme Corp Urteil vom 3. Mai 2015 in der Sache Revision"
    gold = ents(spark, [("1", "K.", "person"), ("2", "Markenstelle fuer Klasse 2", "company"), ("3", "§ 24 Abs. 4 Vertrag", "agreement"), ("4", "Koch", "person"), ("5", "Acme Corp", "company")])
    pred = ents(spark, [("a", "Acme Corp", "company"), ("b", "Beschluss der Markenstelle fuer Klasse 2", "agreement"), ("c", "Planet Zorg", "person"), ("d", "Urteil vom 3. Mai 2015 in der Sache", "agreement"), ("e", "Revision", "agreement")])
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    aligned = metrics.align(metrics.similarities(gold, pred))
    got = {(r.side, r["class"]): r.n for r in metrics.diagnose(gold, pred, aligned, docs).collect()}
    assert got == {("missed", c): 1 for c in ("anonymised_placeholder", "boundary_mismatch", "reference_like", "absent")} | {("extra", c): 1 for c in ("boundary_variant", "unsupported", "descriptive_phrase", "plain_extra")}
    s = {r.variant: (r.tp, r.fp, r.fn) for r in metrics.sensitivity(gold, pred, aligned).collect()}
    assert s["baseline"] == (1, 4, 4) and s["all_filters_combined (ceiling)"] == (1, 1, 1)


def test_bootstrap(spark):
    make = lambda rows: spark.createDataFrame([(f"d{i}", *r, True) for i, r in enumerate(rows)], "doc_id string, tp long, fp long, fn long, precise boolean")
    f1 = lambda df: metrics.bootstrap(df, 300).where("metric = 'f1'").first()
    same = f1(make([(8, 2, 2)] * 40))
    assert same.hi - same.lo < 1e-9 and same.lo == pytest.approx(0.8)
    mixed = f1(make([(10, 0, 0), (0, 5, 5)] * 5))
    assert mixed.hi - mixed.lo > 0.05
    assert metrics.bootstrap(make([(1, 0, 0)])).count() == 0


def test_bootstrap_equals_drawing_documents(spark):
    """Ends of the interval against plain draws of documents, whatever the blocks; the same for a seed, another for another."""
    rng = np.random.default_rng(5)
    docs = [tuple(int(x) for x in rng.integers(0, 9, 3)) for _ in range(120)]
    df = spark.createDataFrame([(f"d{i}", *d, True) for i, d in enumerate(docs)], "doc_id string, tp long, fp long, fn long, precise boolean")
    ends = lambda frame, **options: {r.metric: (r.lo, r.hi) for r in metrics.bootstrap(frame, 2_000, **options).collect()}
    one, blocks, again, other = ends(df), ends(df.repartition(5), rows_per_block=7), ends(df.repartition(7), rows_per_block=7), ends(df, seed=8)
    assert blocks == again and one != other
    sums = np.array([np.array(docs)[rng.integers(0, len(docs), len(docs))].sum(axis=0) for _ in range(4_000)])
    tp, fp, fn = sums.T
    for metric, values in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("f1", 2 * tp / (2 * tp + fp + fn))):
        for got in (one, blocks):
            assert np.allclose(got[metric], np.quantile(values, [0.025, 0.975]), atol=0.006)


def test_bootstrap_covers_the_true_rate(spark):
    """Of 60 samples about 95 in 100 intervals hold the rate that they were drawn with."""
    rng, hits = np.random.default_rng(6), 0
    for k in range(60):
        size = rng.integers(3, 12, 40)
        tp = rng.binomial(size, 0.7)
        df = spark.createDataFrame([(f"d{i}", int(t), 0, int(n - t), True) for i, (t, n) in enumerate(zip(tp, size, strict=True))], "doc_id string, tp long, fp long, fn long, precise boolean")
        row = metrics.bootstrap(df.coalesce(1), 300, seed=k).where("metric = 'recall'").first()
        hits += row.lo <= 0.7 <= row.hi
    assert 50 <= hits <= 60


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 5, 2))
        w = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.7), 3)
        best = max(sum(w[i, p[i]] if flip else w[p[i], i] for i in range(min(n, m))) for flip in [n <= m] for p in itertools.permutations(range(max(n, m)), min(n, m)))
        got = metrics.assign([(i, j, w[i, j]) for i in range(n) for j in range(m) if w[i, j] > 0])
        assert sum(w[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_relation_checks_in_order(spark):
    rows = [
        ("d", 0, "E1", "controls", "E2", "company", "company", 5), ("d", 1, "E1", "controls", "E2", "company", "company", 9), ("d", 2, "E1", "controls", None, "company", None, 5),
        ("d", 3, "E3", "controls", "E1", "agreement", "company", 5), ("d", 4, "E2", "controls", "E1", "company", "company", None), ("d", 5, "E1", "related_to", "E3", "company", "agreement", 1), ("d", 6, "E1", "owns", "E2", "company", "company", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id string, pos int, source string, relation string, target string, source_type string, target_type string, start_char int")
    got = {r.pos: r.reject for r in passes.check_relations(df, S.rules_table(spark)).collect()}
    assert got == {0: None, 1: "duplicate", 2: "unresolved", 3: "bad_direction", 4: "no_evidence", 5: None, 6: "bad_direction"}
    assert {r.pos: r.reject for r in passes.check_relations(df, S.rules_table(spark), require_evidence=False).collect()}[4] is None


def test_recall_checks(spark):
    rows = [("d", 0, "Acme GmbH", "about Acme GmbH here", 6), ("d", 1, "Zeta Bank", "Zeta Bank pays", None), ("d", 2, "Zeta Bank AG", "the Zeta Bank AG", 4), ("d", 3, "Zeta Bank", "Zeta Bank", 0), ("d", 4, "Nowhere", "else", 0)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, name string, chunk string, start_char int")
    known = spark.createDataFrame([("d", "acme")], "doc_id string, k string")
    assert {r.pos: r.reject for r in passes.check_missed(df, known).collect()} == {0: "duplicate", 1: "no_evidence", 2: None, 3: "duplicate", 4: "not_in_text"}


def test_graph_keeps_the_last_edge(spark):
    e = spark.createDataFrame([("E1",), ("E2",)], "entity_id string")
    r = spark.createDataFrame([("[E1]", "E2", "controls", 0), ("E1", "E2", "governs", 1), ("E1", "ghost", "controls", 2)], "source string, target string, relation string, pos int")
    assert [(x.source, x.target, x.relation) for x in graph.build(e, r).collect()] == [("E1", "E2", "governs")]


def test_guardrail_reasons(spark):
    chunks = spark.createDataFrame([("d", 0, "Acme  Corp\nsigned. Ltd.")], "doc_id string, chunk_id int, text string")
    rows = [("Acme Corp", "Acme Corp signed."), ("Acme Corp", "Acme  Corp"), ("Ltd.", "Ltd."), ("$5", "signed"), ("Zeta", "never said")]
    props = spark.createDataFrame([("d", 0, n, "company", q) for n, q in rows], "doc_id string, chunk_id int, entity_name string, entity_type string, exact_quote string")
    got = {(r.entity_name, r.exact_quote): (r.is_valid, r.start_char, r.fail_reason) for r in anchor.guardrail(props, chunks).collect()}
    assert got["Acme Corp", "Acme Corp signed."] == (True, -1, None) and got["Acme Corp", "Acme  Corp"] == (True, 0, None)
    assert "collapsed" in got["Ltd.", "Ltd."][2] and "junk" in got["$5", "signed"][2] and "Hallucination" in got["Zeta", "never said"][2]


def test_ledger_and_gate(spark):
    runs = spark.createDataFrame([("a", "completed", 1.0, 2.0), ("b", "failed", 0.5, 1.0)], "run_id string, status string, cost_usd double, latency_s double")
    r = ops.roll_up(runs).first()
    assert (r.runs, r.failed_runs, r.wasted_usd_failed_runs) == (2, 1, 0.5)
    m = lambda v: spark.createDataFrame([("entity_f1_lenient", v), ("x", v)], "metric string, value double")
    assert metrics.gate(m(0.5), m(0.6)).count() == 1 and metrics.gate(m(0.59), m(0.6)).count() == 0
    one = spark.range(1).select(*ops.efficiency(F.lit(1.0), F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(1.0))).first()
    assert set(one) == {None}


def test_greedy_spans(spark):
    df = spark.createDataFrame([("d", 0, 10, "a"), ("d", 0, 20, "b"), ("d", 5, 30, "c"), ("d", 20, 25, "e")], "doc_id string, start_char int, end_char int, entity_id string")
    assert [(s.start_char, s.end_char) for s in anchor.greedy_spans(df).first().spans] == [(0, 20), (20, 25)]


def test_components_of_shuffled_chains(spark):
    from factloom.operators import resolve

    ids = [f"v{i:03d}" for i in range(60)]
    edges = [(ids[i], ids[i + 1]) for i in range(59) if i % 20 != 19]
    random.Random(3).shuffle(edges)
    v = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.comp for r in resolve.label_components(spark.createDataFrame(edges, "a string, b string"), v).collect()}
    assert got == {f"v{i:03d}": f"v{i // 20 * 20:03d}" for i in range(60)}
