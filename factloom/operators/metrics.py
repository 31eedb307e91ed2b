"""Scoring predictions against labels.

Null means "not applicable" and never zero.  All comparisons stay inside a document.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy
from ..functions import text as T
from ..sources.shared import store
from . import resolve, similar
from .grouped import map_groups

TYPE_BONUS = 0.01


def prf(tp: Column, fp: Column, fn: Column, precise: Column | None = None) -> list[Column]:
    """precision, recall, f1; precision and f1 are null where ``precise`` is false."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.try_divide(2.0 * tp, 2.0 * tp + fp + fn)
    if precise is not None:
        p, f1 = F.when(precise, p), F.when(precise, f1)
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


# --- alignment -------------------------------------------------------------------------------------------------------


def _keys(df: DataFrame) -> DataFrame:
    """(doc_id, id, strict, core) of each surface form of (doc_id, id, forms)."""
    rows = df.select("doc_id", "id", F.explode("forms").alias("form"))
    return rows.select("doc_id", "id", T.norm_name(F.col("form")).alias("strict"), T.core_name(F.col("form")).alias("core")).distinct()


def name_pairs(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, a, b, s) of ids of a document with similar forms, the best over all pairs of forms.

    1 for equal strict keys and 0.97 for equal core names, by joins on the keys; else the ratio of core names that reaches
    ``least``, of pairs that the segment join finds.  Both sides have (doc_id, id, forms).
    """
    one, two = _keys(left), _keys(right)

    def equal(key: str, score: float) -> DataFrame:
        a, b = (x.where(F.col(key) != "").select("doc_id", F.col("id").alias(i), key).distinct() for x, i in ((one, "a"), (two, "b")))
        return a.hint("merge").join(b, ["doc_id", key]).select("doc_id", "a", "b", F.lit(score).alias("s"))  # a row has many forms: no broadcast by its table's size

    cores = [x.select(F.col("doc_id").alias("scope"), "id", F.col("core").alias("s")).distinct() for x in (one, two)]
    close = similar.candidates(*cores, least).where("sa <> sb").withColumn("s", fuzzy.ratio(F.col("sa"), F.col("sb")) / 100).where(F.col("s") >= least)
    pairs = equal("strict", 1.0).unionByName(equal("core", 0.97)).unionByName(close.select(F.col("scope").alias("doc_id"), "a", "b", "s"))
    return pairs.groupBy("doc_id", "a", "b").agg(F.max("s").alias("s"))


def similarities(gold: DataFrame, pred: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, gold_id, pred_id, score) with score > 0: best over surface forms, and a bonus for equal types.

    Both sides have (doc_id, id, type, forms).
    """
    typed = lambda df: df.select("doc_id", F.struct("id", "type").alias("id"), "forms")
    pairs = name_pairs(typed(gold), typed(pred), least)
    bonus = F.when(F.col("a.type") == F.col("b.type"), TYPE_BONUS).otherwise(0.0)
    return pairs.select("doc_id", F.col("a.id").alias("gold_id"), F.col("b.id").alias("pred_id"), (F.col("s") + bonus).alias("score"))


def assign(edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one assignment over sparse (left, right, weight > 0) edges.

    Left vertices come one after another; each takes the cheapest augmenting path to a free right vertex, or to a left one
    that is better off single, by Dijkstra's rounds over reduced costs.  Pairs without an edge are never looked at.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in edges:
        near.setdefault(i, []).append((j, -w))
    u: dict[int, float] = {}  # potentials; staying single costs 0, so those of left vertices are 0 at most
    v: dict[int, float] = {}
    left_of: dict[int, int] = {}
    right_of: dict[int, int] = {}
    for root in sorted(near):
        u[root] = min(0.0, min(c - v.get(j, 0.0) for j, c in near[root]))
        tree, closed = {root: 0.0}, {}  # left vertices and right ones with their distance
        reach: dict[int, float] = {}
        back: dict[int, int] = {}
        heap: list[tuple[float, int]] = []
        at, single, goal, end = root, root, None, float("inf")
        while True:
            if tree[at] - u[at] < end:
                single, end = at, tree[at] - u[at]
            for j, c in near[at]:
                d = tree[at] + c - u[at] - v.get(j, 0.0)
                if j not in closed and d < reach.get(j, float("inf")):
                    reach[j], back[j] = d, at
                    heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in closed or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            d, j = heapq.heappop(heap)
            if j not in left_of:
                goal, end = j, d
                break
            closed[j], at = d, left_of[j]
            tree[at] = d
        for i, d in tree.items():
            u[i] += end - d
        for j, d in closed.items():
            v[j] = v.get(j, 0.0) - (end - d)
        if goal is None:
            if single == root:
                continue
            goal = right_of.pop(single)
        while True:  # turn the path's edges over
            i = back[goal]
            before = right_of.get(i)
            left_of[goal], right_of[i] = i, goal
            if i == root:
                break
            goal = before
    return sorted(right_of.items())


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """The best assignment of (doc_id, gold_id, pred_id, score) rows of some documents, a connected component at a time."""
    gold = rows.groupby(["doc_id", "gold_id"], dropna=False).ngroup().to_numpy()
    pred = rows.groupby(["doc_id", "pred_id"], dropna=False).ngroup().to_numpy() + gold.max() + 1
    top = list(range(int(pred.max()) + 1))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, j in zip(gold.tolist(), pred.tolist(), strict=True):
        a, b = root(i), root(j)
        top[max(a, b)] = min(a, b)
    parts: dict[int, list[tuple[int, int, float]]] = {}
    place = {}
    for n, (i, j, w) in enumerate(zip(gold.tolist(), pred.tolist(), rows["score"].tolist(), strict=True)):
        parts.setdefault(root(i), []).append((i, j, w))
        place[i, j] = n
    return rows.iloc[sorted(place[pair] for part in parts.values() for pair in assign(part))]


def align(scored: DataFrame, large: int = 100_000) -> DataFrame:
    """(doc_id, gold_id, pred_id, score) of the best one-to-one assignment by documents.

    Pairs without rivals need no solver.  The others are solved by connected components, many documents to a task; those
    of a document with more than ``large`` pairs are dealt to tasks by component first, so that it takes many.
    """
    kinds = dict(scored.dtypes)
    counted = scored.withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "gold_id"))).withColumn("_p", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "pred_id")))
    counted = store(counted)
    single = (F.col("_g") == 1) & (F.col("_p") == 1)
    easy = counted.where(single).select("doc_id", "gold_id", "pred_id", "score")
    hard = counted.where(~single).select("doc_id", "gold_id", "pred_id", "score", F.lit("").alias("_part"))
    big = [r[0] for r in hard.groupBy("doc_id").count().where(F.col("count") > large).select("doc_id").collect()]  # each with over ``large`` pairs: few
    if big:
        in_big = F.col("doc_id").isin(big)
        mine = hard.where(in_big).drop("_part")
        g, p = (F.concat_ws("\x01", F.col("doc_id").cast("string"), F.lit(side), F.col(c).cast("string")) for side, c in (("g", "gold_id"), ("p", "pred_id")))
        links = store(mine.select(g.alias("a"), p.alias("b")))
        parts = resolve.label_components(links, links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        dealt = mine.withColumn("_id", g).join(parts.select(F.col("id").alias("_id"), F.col("comp").alias("_part")), "_id").drop("_id")
        hard = hard.where(~in_big).unionByName(dealt)
    solved = map_groups(hard, ["doc_id", "_part"], [], lambda rows: _solve(rows)[["doc_id", "gold_id", "pred_id", "score"]], f"doc_id {kinds['doc_id']}, gold_id {kinds['gold_id']}, pred_id {kinds['pred_id']}, score double")
    return easy.unionByName(solved)


# --- entities --------------------------------------------------------------------------------------------------------


def entity_counts(gold: DataFrame, pred: DataFrame, aligned: DataFrame, strict: bool, scope: DataFrame | None = None) -> DataFrame:
    """(doc_id, tp, fp, fn, precise).  Strictly, a type error is a false positive and a false negative.

    ``scope`` has (doc_id, types): unaligned predictions of other types are no false positives; an empty list leaves
    precision undefined.  Documents without predictions count as all missed.
    """
    g, p = gold.select("doc_id", F.col("id").alias("gold_id"), F.col("type").alias("gt")), pred.select("doc_id", F.col("id").alias("pred_id"), F.col("type").alias("pt"))
    pairs = aligned.join(g, ["doc_id", "gold_id"]).join(p, ["doc_id", "pred_id"]).withColumn("hit", F.lit(True) if not strict else F.col("gt") == F.col("pt"))
    tp = pairs.groupBy("doc_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("wrong"))
    fn = g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"))
    rest = p.join(aligned.select("doc_id", "pred_id"), ["doc_id", "pred_id"], "left_anti")
    if scope is not None:
        rest = rest.join(scope, "doc_id", "left").where(F.col("types").isNull() | (F.size("types") == 0) | F.array_contains("types", F.col("pt")))
    extra = rest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("extra"))
    docs = gold.select("doc_id").union(pred.select("doc_id")).distinct()
    rows = docs.join(tp, "doc_id", "left").join(fn, "doc_id", "left").join(extra, "doc_id", "left").na.fill(0)
    if scope is not None:
        rows = rows.join(scope, "doc_id", "left").withColumn("precise", F.coalesce(F.size("types") > 0, F.lit(True)))
    else:
        rows = rows.withColumn("precise", F.lit(True))
    return rows.select("doc_id", "tp", (F.col("extra") + F.col("wrong")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), "precise")


def summarise(counts: DataFrame) -> DataFrame:
    """One row: sums, micro precision, recall and f1, and the mean of documents' f1 where it is defined."""
    each = counts.withColumn("doc_f1", F.when(F.col("precise"), F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))))
    total = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.bool_and("precise").alias("precise"), F.avg("doc_f1").alias("macro_f1"))
    return total.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn"), F.col("precise")), "macro_f1")


def typing_confusion(gold: DataFrame, pred: DataFrame, aligned: DataFrame) -> DataFrame:
    """(gold_type, pred_type, n) over aligned pairs."""
    rows = aligned.join(gold.select("doc_id", F.col("id").alias("gold_id"), F.col("type").alias("gold_type")), ["doc_id", "gold_id"])
    rows = rows.join(pred.select("doc_id", F.col("id").alias("pred_id"), F.col("type").alias("pred_type")), ["doc_id", "pred_id"])
    return rows.groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("n"))


def alias_recall(gold: DataFrame, pred: DataFrame, aligned: DataFrame) -> DataFrame:
    """(covered, total) gold aliases of aligned entities; covered ones equal a form of the prediction by strict key."""
    g = aligned.join(gold.select("doc_id", F.col("id").alias("gold_id"), F.explode("aliases").alias("alias")), ["doc_id", "gold_id"])
    p = pred.select("doc_id", F.col("id").alias("pred_id"), F.explode("forms").alias("form"))
    keys = p.select("doc_id", "pred_id", T.norm_name(F.col("form")).alias("k")).distinct().withColumn("hit", F.lit(1))
    rows = g.withColumn("k", T.norm_name(F.col("alias"))).join(keys, ["doc_id", "pred_id", "k"], "left")
    return rows.agg(F.count("hit").alias("covered"), F.count(F.lit(1)).alias("total"))


# --- relations -------------------------------------------------------------------------------------------------------

LEVELS = {"strict": ["s", "relation", "t"], "undirected": ["lo", "hi", "relation"], "untyped": ["s", "t"], "pair": ["lo", "hi"]}


def relation_counts(gold: DataFrame, pred: DataFrame, level: str) -> DataFrame:
    """(doc_id, tp, fp, fn) of distinct relations at a level.

    Both sides have (doc_id, source, relation, target) in gold ids; predicted ends without a gold entity keep ids of their
    own, so they can't match.
    """
    keys = LEVELS[level]

    def distinct(df: DataFrame, flag: str) -> DataFrame:
        rows = df.select("doc_id", "relation", F.col("source").alias("s"), F.col("target").alias("t"), F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))
        return rows.select("doc_id", *keys).distinct().withColumn(flag, F.lit(1))

    both = distinct(gold, "g").join(distinct(pred, "p"), ["doc_id", *keys], "full_outer")
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )


def mapped_relations(relations: DataFrame, aligned: DataFrame) -> DataFrame:
    """Predicted relations with gold ids where their ends are aligned, else "?" and their own."""
    end = lambda c: aligned.select("doc_id", F.col("pred_id").alias(c), F.col("gold_id").alias(f"{c}_gold"))
    rows = relations.join(end("source"), ["doc_id", "source"], "left").join(end("target"), ["doc_id", "target"], "left")
    own = lambda c: F.coalesce(f"{c}_gold", F.concat(F.lit("?"), F.col(c)))
    return rows.select("doc_id", own("source").alias("source"), "relation", own("target").alias("target"))


# --- coreference -----------------------------------------------------------------------------------------------------


def cluster_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, pairwise and B-cubed and MUC sums) for (doc_id, item, cluster) assignments of both sides.

    Sums over items and clusters only: a group of n items never makes its pairs.
    """
    items = gold.select("doc_id", "item", F.col("cluster").alias("g")).join(pred.select("doc_id", "item", F.col("cluster").alias("p")), ["doc_id", "item"], "full_outer")
    items = items.withColumn("g", F.coalesce("g", F.concat(F.lit("!"), "item"))).withColumn("p", F.coalesce("p", F.concat(F.lit("!"), "item")))
    cells = items.groupBy("doc_id", "g", "p").agg(F.count(F.lit(1)).alias("n"))
    over = lambda c: F.sum("n").over(Window.partitionBy("doc_id", c))
    cells = cells.withColumn("gn", over("g")).withColumn("pn", over("p"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    a = cells.groupBy("doc_id").agg(
        F.sum("n").alias("items"), F.sum(pairs("n")).alias("pair_both"), F.sum(F.col("n") * F.col("n") / F.col("pn")).alias("b3_p"), F.sum(F.col("n") * F.col("n") / F.col("gn")).alias("b3_r")
    )
    g = cells.groupBy("doc_id", "g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).groupBy("doc_id").agg(F.sum(pairs("n")).alias("pair_gold"), F.sum(F.col("n") - F.col("parts")).alias("muc_r_num"), F.sum(F.col("n") - 1).alias("muc_r_den"))
    p = cells.groupBy("doc_id", "p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).groupBy("doc_id").agg(F.sum(pairs("n")).alias("pair_pred"), F.sum(F.col("n") - F.col("parts")).alias("muc_p_num"), F.sum(F.col("n") - 1).alias("muc_p_den"))
    return a.join(g, "doc_id").join(p, "doc_id")


def cluster_scores(counts: DataFrame) -> DataFrame:
    """Precision and recall of each kind; null where the labels have nothing to merge."""
    some = F.col("pair_gold") > 0
    d = F.try_divide
    return counts.select(
        "doc_id",
        F.when(some, d(F.col("pair_both"), F.col("pair_pred"))).alias("pair_precision"),
        F.when(some, d(F.col("pair_both"), F.col("pair_gold"))).alias("pair_recall"),
        F.when(some, d(F.col("b3_p"), F.col("items"))).alias("b3_precision"),
        F.when(some, d(F.col("b3_r"), F.col("items"))).alias("b3_recall"),
        F.when(some, d(F.col("muc_p_num"), F.col("muc_p_den"))).alias("muc_precision"),
        F.when(some, d(F.col("muc_r_num"), F.col("muc_r_den"))).alias("muc_recall"),
    )


def ceaf_e(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, precision, recall): entity-based alignment of clusters by 2 * overlap / (sizes)."""
    size = lambda df, n: df.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias(n))
    both = gold.select("doc_id", "item", F.col("cluster").alias("gold_id")).join(pred.select("doc_id", "item", F.col("cluster").alias("pred_id")), ["doc_id", "item"])
    cells = both.groupBy("doc_id", "gold_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(size(gold, "gn").withColumnRenamed("cluster", "gold_id"), ["doc_id", "gold_id"]).join(size(pred, "pn").withColumnRenamed("cluster", "pred_id"), ["doc_id", "pred_id"])
    best = align(cells.select("doc_id", "gold_id", "pred_id", (2 * F.col("n") / (F.col("gn") + F.col("pn"))).alias("score"))).groupBy("doc_id").agg(F.sum("score").alias("sim"))
    count = lambda df, n: df.groupBy("doc_id").agg(F.countDistinct("cluster").alias(n))
    rows = count(gold, "g").join(count(pred, "p"), "doc_id").join(best, "doc_id", "left")
    return rows.select("doc_id", (F.coalesce("sim", F.lit(0.0)) / F.col("p")).alias("precision"), (F.coalesce("sim", F.lit(0.0)) / F.col("g")).alias("recall"))


# --- provenance and structure ----------------------------------------------------------------------------------------


def provenance(quotes: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, quotes, verbatim, placeholder, entities, cited, unsupported).

    ``quotes`` has (doc_id, entity_id, quote); an entity is unsupported if its name isn't in the text.
    """
    texts = docs.select("doc_id", T.squeeze(F.col("text")).alias("squeezed"), F.col("text"))
    placeholder = T.is_placeholder(F.col("quote"))
    q = quotes.join(texts, "doc_id").withColumn("_ph", placeholder).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(~F.col("_ph") & F.contains("squeezed", T.squeeze(F.col("quote")))).alias("verbatim"), F.count_if("_ph").alias("placeholder")
    )
    cited = quotes.select("doc_id", "entity_id").distinct().withColumn("_c", F.lit(1))
    e = entities.join(cited, ["doc_id", "entity_id"], "left").join(texts, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entities"), F.count("_c").alias("cited"), F.count_if(~F.contains(F.lower("squeezed"), F.lower(T.squeeze(F.col("name"))))).alias("unsupported")
    )
    return e.join(q, "doc_id", "left").na.fill(0, ["quotes", "verbatim", "placeholder"])


def intrinsic(entities: DataFrame, relations: DataFrame, rules: DataFrame, relation_types: list[str]) -> DataFrame:
    """Structural health by document; rates have all relations, or all entities, below."""
    from .anchor import allowed_direction

    names = entities.withColumn("k", T.norm_name(F.col("name"))).where("k <> ''").groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("kinds"))
    groups = names.groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_entity_groups"), F.count_if(F.col("kinds") > 1).alias("type_conflict_names"), F.sum(F.col("n") - 1).alias("surplus"))
    end = lambda c: entities.select("doc_id", F.col("entity_id").alias(c), F.col("type").alias(f"{c}_type"))
    rows = relations.join(end("source"), ["doc_id", "source"], "left").join(end("target"), ["doc_id", "target"], "left")
    rows = allowed_direction(rows, rules)
    known, ends = F.col("relation").isin(relation_types), F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    rates = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(known & ends & ~F.col("allowed")).alias("bad_direction"),
        F.count_if(~ends).alias("dangling"),
        F.count_if(~known).alias("unknown_type"),
        F.countDistinct("source", "relation", "target").alias("distinct_relations"),
    )
    touched = relations.select("doc_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    orphans = entities.join(touched, ["doc_id", "entity_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("orphans"))
    total = entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"))
    out = total.join(groups, "doc_id", "left").join(rates, "doc_id", "left").join(orphans, "doc_id", "left").na.fill(0)
    share = lambda c, of: F.try_divide(F.col(c), F.col(of))
    return out.select(
        "doc_id", "entities", "relations", "duplicate_entity_groups", "type_conflict_names",
        share("surplus", "entities").alias("duplicate_entity_rate"), share("bad_direction", "relations").alias("direction_violation_rate"),
        share("dangling", "relations").alias("dangling_relation_rate"), share("unknown_type", "relations").alias("unknown_relation_type_rate"),
        F.try_divide(F.col("relations") - F.col("distinct_relations"), F.col("relations")).alias("duplicate_relation_rate"), share("orphans", "entities").alias("orphan_entity_rate"),
    )


# --- diagnostics -----------------------------------------------------------------------------------------------------

_REFERENCE = "§|(?i)\\b(art|abs|nr|no|section|article|clause)\\b\\.?\\s*\\d|\\d"
_DESCRIPTIVE = "(?i)\\b(vom|von|der|des|in|of|the|dated|und|and)\\b"


def missed_class(name: Column, boundary: Column) -> Column:
    """Why a label was missed; ``boundary`` says that a prediction contains it or is in it."""
    return F.when(name.rlike("^\\p{L}\\.?$"), "anonymised_placeholder").when(boundary, "boundary_mismatch").when(name.rlike(_REFERENCE), "reference_like").otherwise("absent")


def extra_class(name: Column, boundary: Column, supported: Column) -> Column:
    """What kind of surplus a prediction is."""
    phrase = (F.size(F.split(name, " ")) >= 4) & name.rlike(_DESCRIPTIVE)
    return F.when(boundary, "boundary_variant").when(~supported, "unsupported").when(phrase, "descriptive_phrase").otherwise("plain_extra")


def diagnose(gold: DataFrame, pred: DataFrame, aligned: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, side, class, n) of missed labels and surplus predictions."""
    g = gold.join(aligned.select("doc_id", F.col("gold_id").alias("id")), ["doc_id", "id"], "left_anti").select("doc_id", "id", "name")
    p = pred.join(aligned.select("doc_id", F.col("pred_id").alias("id")), ["doc_id", "id"], "left_anti").select("doc_id", "id", "name")

    def near(rows: DataFrame, others: DataFrame) -> DataFrame:
        o = others.groupBy("doc_id").agg(F.collect_set(T.norm_key(F.col("name"))).alias("names"))
        k = T.norm_key(F.col("name"))
        hit = F.exists("names", lambda n: (n != k) & (F.char_length(n) >= 3) & (F.char_length(k) >= 3) & (F.contains(n, k) | F.contains(k, n)))
        return rows.join(o, "doc_id", "left").withColumn("boundary", F.coalesce(hit, F.lit(False)))

    missed = near(g, pred).select("doc_id", F.lit("missed").alias("side"), missed_class(F.col("name"), F.col("boundary")).alias("class"))
    extra = near(p, gold).join(docs.select("doc_id", T.squeeze(F.col("text")).alias("sq")), "doc_id")
    extra = extra.select("doc_id", F.lit("extra").alias("side"), extra_class(F.col("name"), F.col("boundary"), F.contains("sq", T.squeeze(F.col("name")))).alias("class"))
    return missed.union(extra).groupBy("doc_id", "side", "class").agg(F.count(F.lit(1)).alias("n"))


def sensitivity(gold: DataFrame, pred: DataFrame, aligned: DataFrame) -> DataFrame:
    """(variant, tp, fp, fn): what the counts would be if labels or predictions of some kinds were left out."""
    a = aligned.select("doc_id", "gold_id", "pred_id")
    g = gold.select("doc_id", F.col("id").alias("gold_id"), F.col("name").alias("gname"), F.col("type").alias("gtype"))
    p = pred.select("doc_id", F.col("id").alias("pred_id"), F.col("name").alias("pname"), F.col("type").alias("ptype"))
    rows = g.join(a, ["doc_id", "gold_id"], "full_outer").join(p, ["doc_id", "pred_id"], "full_outer")
    anonymous, reference = F.col("gname").rlike("^\\p{L}\\.?$"), F.col("gname").rlike("[0-9§]")
    party = F.col("ptype").isin("person", "company")
    gold_party = F.col("gtype").isin("person", "company")
    phrase = (F.size(F.split("pname", " ")) >= 4) & F.col("pname").rlike(_DESCRIPTIVE)
    yes = F.lit(True)
    keep = {
        "baseline": (yes, yes),
        "drop_anonymised": (~anonymous, yes),
        "drop_reference_like": (~reference, yes),
        "person_company_only": (gold_party, party),
        "drop_descriptive": (yes, ~phrase),
        "all_filters_combined (ceiling)": (~anonymous & ~reference, party),
    }
    sums = []
    for name, (kg, kp) in keep.items():
        has_g, has_p = F.col("gname").isNotNull() & F.coalesce(kg, F.lit(False)), F.col("pname").isNotNull() & F.coalesce(kp, F.lit(False))
        sums.append(F.struct(F.lit(name).alias("variant"), F.count_if(has_g & has_p).alias("tp"), F.count_if(has_p & ~has_g).alias("fp"), F.count_if(has_g & ~has_p).alias("fn")))
    return rows.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def bootstrap(counts: DataFrame, n: int = 1000, seed: int = 7, level: float = 0.95, rows_per_block: int = 20_000) -> DataFrame:
    """Interval of micro precision, recall and f1 over documents drawn with replacement; no row for under two documents.

    Documents with equal counts are one row with how many there are, so a replicate is a multinomial draw over such rows.  It
    is drawn by conditional binomials: first how many fall to each block of rows (on the driver, a number a block and
    replicate), then inside every block.  A block's generator follows from the seed and its number, so results repeat.
    """
    spark = counts.sparkSession
    kinds = store(counts.groupBy("tp", "fp", "fn").agg(F.count(F.lit(1)).alias("docs"), F.bool_and("precise").alias("precise")))
    total, different, precise = kinds.agg(F.sum("docs"), F.count(F.lit(1)), F.bool_and("precise")).first()
    if not total or total < 2 or not precise:
        return spark.createDataFrame([], "metric string, lo double, hi double")
    blocks = math.ceil(different / rows_per_block)
    rows = kinds.withColumn("block", F.pmod(F.xxhash64("tp", "fp", "fn"), F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["docs"] for r in rows.groupBy("block").agg(F.sum("docs").alias("docs")).collect()}
    order = sorted(sizes)
    share = np.random.default_rng(seed).multinomial(total, np.array([sizes[b] for b in order]) / total, size=n)
    drawn = {b: share[:, i] for i, b in enumerate(order)}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tp", "fp", "fn"])
        values, chance = pdf[["tp", "fp", "fn"]].to_numpy(dtype=np.int64), pdf["docs"].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, int(key[0])])
        sums = np.array([rng.multinomial(k, chance / chance.sum()) @ values for k in drawn[int(key[0])]])
        return pd.DataFrame({"rep": range(n), "tp": sums[:, 0], "fp": sums[:, 1], "fn": sums[:, 2]})

    reps = rows.groupBy("block").applyInPandas(run, "rep int, tp bigint, fp bigint, fn bigint")
    sums = reps.groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    tail = (1 - level) / 2
    wide = sums.select(p, r, f1).agg(*(F.percentile(c, F.lit(q)).alias(f"{c}_{q}") for c in ("precision", "recall", "f1") for q in (tail, 1 - tail)))
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}_{tail}`").alias("lo"), F.col(f"`{c}_{1 - tail}`").alias("hi")) for c in ("precision", "recall", "f1")))
    return wide.select(F.inline(rows))


def gate(current: DataFrame, baseline: DataFrame, most: float = 0.02, watched: tuple[str, ...] | None = ("entity_f1_lenient", "relation_f1_strict")) -> DataFrame:
    """(metric, value, before, drop) of watched metrics (None: all) that fell by more than ``most``."""
    rows = current.join(baseline.select("metric", F.col("value").alias("before")), "metric")
    rows = rows.where(F.col("metric").isin(*watched)) if watched is not None else rows
    return rows.withColumn("drop", F.col("before") - F.col("value")).where(F.col("drop") > most).select("metric", "value", "before", "drop")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of metrics that both reports have as numbers."""
    rows = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric")
    return rows.where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))
