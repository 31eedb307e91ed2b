"""Queries of metrics (G), assignment and gates (X), the ledger and nested sources (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..operators import metrics as M
from ..operators import ops, report
from ..sources import loaders
from . import inputs as I
from .structure_queries import _PROPOSALS, _RULES, _proposals
from .text_queries import KEY

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _r(c, alias=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(alias) if alias else F.round(c, 6)


@query("g01_group_mentions", f"WITH {I.NAMES}, g AS (SELECT doc_id, {KEY.format(x='name')} AS key, type, min_by(name, k) AS name, CAST(count(*) AS BIGINT) AS mentions, min(k) AS first FROM names GROUP BY 1, 2, 3) SELECT doc_id, doc_id || '#e' || (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1) AS id, name, type, mentions FROM g WHERE key <> ''")
def g01(spark, d):
    m = I.names(spark, d).select("doc_id", F.col("k").alias("pos"), F.col("name").alias("text"), "type", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return loaders.group_mentions(m).select("doc_id", "id", "name", "type", F.size("mentions").cast("bigint").alias("mentions"))


@query("g02_chunk_entity_index", f"WITH {I.ENTITIES}, c AS (SELECT doc_id, entity_id, 0 AS chunk FROM entities UNION ALL SELECT doc_id, entity_id, 1 FROM entities) SELECT doc_id, CAST(chunk AS BIGINT) AS chunk_id, string_agg(entity_id, ',' ORDER BY entity_id) AS entities FROM c GROUP BY 1, 2")
def g02(spark, d):
    rows = I.entities(spark, d).select("doc_id", "entity_id", F.explode("citations.chunk_id").cast("bigint").alias("chunk_id"))
    return rows.groupBy("doc_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("entities"))


QUERIES["g02_chunk_entity_index"] = lambda spark, d: (
    I.entities(spark, d).select("doc_id", "entity_id", F.explode("citations").alias("c")).groupBy("doc_id", F.col("c.chunk_id").cast("bigint").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("entities"))
)


@query("g03_reference_list", f"WITH {I.ENTITIES} SELECT entity_id, canonical_name AS name, 'name' AS kind FROM entities UNION ALL SELECT entity_id, unnest(aliases), 'alias' FROM entities")
def g03(spark, d):
    e = I.entities(spark, d)
    return e.select("entity_id", F.col("canonical_name").alias("name"), F.lit("name").alias("kind")).unionByName(e.select("entity_id", F.explode("aliases").alias("name"), F.lit("alias").alias("kind")))


@query("g04_legacy_rates", rf"WITH {_PROPOSALS}, v AS (SELECT contains(regexp_replace(text, '\s+', ' ', 'g'), regexp_replace(q, '\s+', ' ', 'g')) AS ok, name FROM props) SELECT CAST(count(*) AS BIGINT) AS mentions, CAST(count(*) FILTER (ok) AS BIGINT) AS valid, round(count(*) FILTER (NOT ok) / greatest(1, count(*)), 6) AS hallucination_rate, round(count(*) / greatest(1, count(DISTINCT name)), 6) AS compression FROM v")
def g04(spark, d):
    p, c = _proposals(spark, d)
    ok = F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("exact_quote")))
    rows = p.join(c.drop("chunk_id"), "doc_id").select(ok.alias("ok"), "entity_name")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("mentions"), F.count_if("ok").alias("valid"), _r(F.count_if(~F.col("ok")) / F.greatest(F.lit(1), n), "hallucination_rate"), _r(n / F.greatest(F.lit(1), F.countDistinct("entity_name")), "compression"))


_COUNTS = """docs AS (SELECT doc_id FROM gold UNION SELECT doc_id FROM pred),
h AS (SELECT doc_id, count(*) FILTER ({hit}) AS tp, count(*) FILTER (NOT {hit}) AS wrong FROM aligned GROUP BY 1), g AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY 1),
e AS (SELECT doc_id, count(*) AS n FROM pred WHERE (doc_id, id) NOT IN (SELECT doc_id, pred_id FROM aligned) AND type <> 'asset' GROUP BY 1),
counts AS (SELECT d.doc_id, coalesce(h.tp, 0) AS tp, coalesce(e.n, 0) + coalesce(wrong, 0) AS fp, coalesce(g.n, 0) - coalesce(h.tp, 0) AS fn FROM docs d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id))"""


def _counts(spark, d, strict):
    gold, pred, aligned = I.labelled(spark, d)
    scope = gold.select("doc_id").union(pred.select("doc_id")).distinct().select("doc_id", F.array(F.lit("person"), F.lit("company")).alias("types"))
    return M.entity_counts(gold, pred, aligned, strict, scope)


for _name, _strict in (("strict", True), ("lenient", False)):
    _hit = "gt = pt" if _strict else "true"
    QUERIES[f"g05_entity_counts_{_name}"] = lambda spark, d, s=_strict: _counts(spark, d, s).select("doc_id", "tp", "fp", "fn")
    ORACLE_SQL[f"g05_entity_counts_{_name}"] = f"WITH {I.LABELLED}, {_COUNTS.format(hit=_hit)} SELECT doc_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM counts"
    QUERIES[f"g06_micro_macro_{_name}"] = lambda spark, d, s=_strict: M.summarise(_counts(spark, d, s)).select("tp", "fp", "fn", *(_r(c, c) for c in ("precision", "recall", "f1", "macro_f1")))
    ORACLE_SQL[f"g06_micro_macro_{_name}"] = f"WITH {I.LABELLED}, {_COUNTS.format(hit=_hit)} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1 FROM counts"


@query("g07_typing_confusion", f"WITH {I.LABELLED} SELECT gt AS gold_type, pt AS pred_type, CAST(count(*) AS BIGINT) AS n FROM aligned GROUP BY 1, 2")
def g07(spark, d):
    return M.typing_confusion(*I.labelled(spark, d))


def _alias_sides(spark, d):
    e = I.entities(spark, d)
    gold = e.select("doc_id", F.col("entity_id").alias("id"), F.concat(F.array("canonical_name"), "aliases").alias("aliases"))
    pred = e.where("pos % 4 <> 1").select("doc_id", F.concat(F.lit("p"), "entity_id").alias("id"), F.array(F.expr("CASE WHEN pos % 4 = 2 THEN upper(canonical_name) ELSE 'nothing' END")).alias("forms"))
    aligned = pred.select("doc_id", F.expr("substring(id, 2)").alias("gold_id"), F.col("id").alias("pred_id"))
    return gold, pred, aligned


@query("g08_alias_recall", f"WITH {I.ENTITIES}, a AS (SELECT pos, canonical_name, unnest(list_concat([canonical_name], aliases)) AS alias FROM entities WHERE pos % 4 <> 1) SELECT CAST(count(*) FILTER (pos % 4 = 2 AND {KEY.format(x='alias')} = {KEY.format(x='canonical_name')}) AS BIGINT) AS covered, CAST(count(*) AS BIGINT) AS total FROM a")
def g08(spark, d):
    return M.alias_recall(*_alias_sides(spark, d))


_LEVEL = {"strict": "source AS a, relation AS b, target AS c", "undirected": "least(source, target) AS a, relation AS b, greatest(source, target) AS c", "untyped": "source AS a, '' AS b, target AS c", "pair": "least(source, target) AS a, '' AS b, greatest(source, target) AS c"}
for _level, _cols in _LEVEL.items():
    QUERIES[f"g09_relation_{_level}"] = lambda spark, d, lv=_level: M.relation_counts(I.gold_relations(spark, d), I.pred_relations(spark, d), lv)
    ORACLE_SQL[f"g09_relation_{_level}"] = f"WITH {I.RELATIONS}, g AS (SELECT DISTINCT doc_id, {_cols}, 1 AS g FROM gold), p AS (SELECT DISTINCT doc_id, {_cols}, 1 AS p FROM pred) SELECT doc_id, CAST(count(*) FILTER (g = 1 AND p = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (g IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (p IS NULL) AS BIGINT) AS fn FROM g FULL JOIN p USING (doc_id, a, b, c) GROUP BY 1"


def _clusters(spark, d):
    n = I.names(spark, d)
    gold = n.select("doc_id", F.col("k").cast("string").alias("item"), F.expr("concat('g', cast(k div 4 as string))").alias("cluster"))
    pred = n.select("doc_id", F.col("k").cast("string").alias("item"), F.expr("concat('p', CASE WHEN k % 5 = 0 THEN cast(k as string) ELSE concat('m', cast(k div 6 as string)) END)").alias("cluster"))
    return gold, pred


_CL = f"{I.NAMES}, i AS (SELECT doc_id, k, k // 4 AS g, CASE WHEN k % 5 = 0 THEN 'x' || k ELSE 'm' || (k // 6) END AS p FROM names)"


@query("g10_coreference", f"""WITH {_CL}, c AS (SELECT doc_id, g, p, count(*) AS n FROM i GROUP BY 1, 2, 3), s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, g) AS gn, sum(n) OVER (PARTITION BY doc_id, p) AS pn, count(*) OVER (PARTITION BY doc_id, g) AS gp, count(*) OVER (PARTITION BY doc_id, p) AS pp FROM c),
a AS (SELECT doc_id, sum(n) AS items, sum(n * (n - 1) / 2) AS pb, sum(n * n / pn) AS bp, sum(n * n / gn) AS br FROM s GROUP BY 1),
gg AS (SELECT doc_id, sum(gn * (gn - 1) / 2) AS pg, sum(gn - gp) AS rn, sum(gn - 1) AS rd FROM (SELECT DISTINCT doc_id, g, gn, gp FROM s) GROUP BY 1), qq AS (SELECT doc_id, sum(pn * (pn - 1) / 2) AS pp, sum(pn - pp) AS qn, sum(pn - 1) AS qd FROM (SELECT DISTINCT doc_id, p, pn, pp FROM s) GROUP BY 1)
SELECT doc_id, CASE WHEN pg > 0 THEN round(pb / nullif(pp, 0), 6) END AS pair_precision, CASE WHEN pg > 0 THEN round(pb / pg, 6) END AS pair_recall, CASE WHEN pg > 0 THEN round(bp / items, 6) END AS b3_precision, CASE WHEN pg > 0 THEN round(br / items, 6) END AS b3_recall,
CASE WHEN pg > 0 THEN round(qn / nullif(qd, 0), 6) END AS muc_precision, CASE WHEN pg > 0 THEN round(rn / nullif(rd, 0), 6) END AS muc_recall FROM a JOIN gg USING (doc_id) JOIN qq USING (doc_id)""")
def g10(spark, d):
    rows = M.cluster_scores(M.cluster_counts(*_clusters(spark, d)))
    return rows.select("doc_id", *(_r(c, c) for c in rows.columns if c != "doc_id"))


@query("g10_ceaf_e")
def g10b(spark, d):
    rows = M.ceaf_e(*_clusters(spark, d))
    return rows.select("doc_id", _r("precision", "precision"), _r("recall", "recall"))


_QUOTE = "CASE doc_id % 4 WHEN 0 THEN '#/texts/0' WHEN 1 THEN replace(substring(text, 5, 40), ' ', '  ') WHEN 2 THEN 'invented words that nobody wrote' ELSE substring(text, 3, 30) END"
_ENAME = "CASE doc_id % 3 WHEN 0 THEN substring(text, 1, 9) ELSE 'Nobody Ltd' END"


@query("g11_provenance", rf"""WITH e AS (SELECT doc_id, text, {_ENAME} AS name, {_QUOTE} AS q, regexp_matches({_QUOTE}, '^#/|^\s*$|^NA$') AS ph FROM documents) SELECT doc_id, CAST(1 AS BIGINT) AS entities, CAST(1 AS BIGINT) AS cited, CASE WHEN contains(lower(regexp_replace(text, '\s+', ' ', 'g')), lower(regexp_replace(name, '\s+', ' ', 'g'))) THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS unsupported,
CAST(1 AS BIGINT) AS quotes, CASE WHEN NOT ph AND contains(regexp_replace(text, '\s+', ' ', 'g'), regexp_replace(q, '\s+', ' ', 'g')) THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS verbatim, CASE WHEN ph THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS placeholder FROM e""")
def g11(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    ents = docs.select("doc_id", F.lit("e").alias("entity_id"), F.expr(_ENAME).alias("name"))
    return M.provenance(docs.select("doc_id", F.lit("e").alias("entity_id"), F.expr(_QUOTE).alias("quote")), ents, docs)


_INTRINSIC = f"""{I.ENTITIES}, {I.EDGES}, {_RULES}, nk AS (SELECT doc_id, {KEY.format(x='canonical_name')} AS key, count(*) AS n, count(DISTINCT entity_type) AS kinds FROM entities GROUP BY 1, 2),
gr AS (SELECT doc_id, count(*) FILTER (n > 1) AS dg, count(*) FILTER (kinds > 1) AS tc, sum(n - 1) AS surplus FROM nk WHERE key <> '' GROUP BY 1),
x AS (SELECT e.doc_id, e.source, e.target, e.relation, a.entity_type AS st, b.entity_type AS tt FROM edges e LEFT JOIN entities a ON a.doc_id = e.doc_id AND a.entity_id = e.source LEFT JOIN entities b ON b.doc_id = e.doc_id AND b.entity_id = e.target),
y AS (SELECT *, (EXISTS (SELECT 1 FROM rules r WHERE r.relation = x.relation AND ((r.st = x.st AND r.tt = x.tt) OR r.st = 'any'))) AS ok, relation <> 'owns' AS known, st IS NOT NULL AND tt IS NOT NULL AS ends FROM x),
rt AS (SELECT doc_id, count(*) AS n, count(*) FILTER (known AND ends AND NOT ok) AS bad, count(*) FILTER (NOT ends) AS dangling, count(*) FILTER (NOT known) AS unk, count(DISTINCT (source, relation, target)) AS dr FROM y GROUP BY 1),
ot AS (SELECT doc_id, count(*) AS n FROM entities e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.doc_id = e.doc_id AND (x.source = e.entity_id OR x.target = e.entity_id)) GROUP BY 1),
tot AS (SELECT doc_id, count(*) AS n FROM entities GROUP BY 1),
intr AS (SELECT t.doc_id, CAST(t.n AS BIGINT) AS entities, CAST(coalesce(rt.n, 0) AS BIGINT) AS relations, CAST(coalesce(dg, 0) AS BIGINT) AS duplicate_entity_groups, CAST(coalesce(tc, 0) AS BIGINT) AS type_conflict_names, round(coalesce(surplus, 0) / t.n, 6) AS duplicate_entity_rate, round(bad / rt.n, 6) AS direction_violation_rate, round(dangling / rt.n, 6) AS dangling_relation_rate,
round(unk / rt.n, 6) AS unknown_relation_type_rate, round((rt.n - dr) / rt.n, 6) AS duplicate_relation_rate, round(coalesce(ot.n, 0) / t.n, 6) AS orphan_entity_rate FROM tot t LEFT JOIN gr USING (doc_id) LEFT JOIN rt USING (doc_id) LEFT JOIN ot USING (doc_id))"""
_RATES = ("duplicate_entity_rate", "direction_violation_rate", "dangling_relation_rate", "unknown_relation_type_rate", "duplicate_relation_rate", "orphan_entity_rate")


def _intrinsic(spark, d):
    ents = I.entities(spark, d).select("doc_id", "entity_id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"))
    rows = M.intrinsic(ents, I.edges(spark, d), S.rules_table(spark), S.RELATION_TYPES)
    return rows.select(*(_r(c, c) if c in _RATES else F.col(c) for c in rows.columns))


QUERIES["g12_intrinsic"] = _intrinsic
ORACLE_SQL["g12_intrinsic"] = f"WITH {_INTRINSIC} SELECT * FROM intr"


@query("g13_intrinsic_aggregate", f"WITH {_INTRINSIC} SELECT CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations, CAST(sum(duplicate_entity_groups) AS BIGINT) AS duplicate_entity_groups, CAST(sum(type_conflict_names) AS BIGINT) AS type_conflict_names, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _RATES) + " FROM intr")
def g13(spark, d):
    return _intrinsic(spark, d).agg(*(F.sum(c).alias(c) for c in ("entities", "relations", "duplicate_entity_groups", "type_conflict_names")), *(_r(F.avg(c), c) for c in _RATES))


def _named(spark, d):
    gold, pred, aligned = I.labelled(spark, d)
    name = lambda df: df.withColumn("name", F.expr("CASE substring(id, -1) WHEN '0' THEN 'K.' WHEN '1' THEN concat('§ ', substring(id, 2), ' Vertrag') WHEN '2' THEN 'Koch' ELSE concat('Firma Nr', substring(id, 2)) END"))
    extra = F.expr("CASE substring(id, -1) WHEN '0' THEN 'Urteil vom Mai in der Sache' WHEN '1' THEN concat('Die § ', substring(id, 2), ' Vertrag') WHEN '2' THEN 'Revision' ELSE 'Planet Zorg' END")
    docs = gold.select("doc_id").union(pred.select("doc_id")).distinct().withColumn("text", F.lit("Urteil vom Mai in der Sache Revision Koch"))
    return name(gold), pred.withColumn("name", extra), aligned.where("substring(gold_id, -1) <> '1'"), docs


@query("g14_error_taxonomy")
def g14(spark, d):
    return M.diagnose(*_named(spark, d))


_SENS = f"""{I.LABELLED}, ga AS (SELECT doc_id, id, type, CASE substring(id, -1) WHEN '0' THEN 'K.' WHEN '1' THEN '§ ' || substring(id, 2) || ' Vertrag' WHEN '2' THEN 'Koch' ELSE 'Firma Nr' || substring(id, 2) END AS name FROM gold),
pa AS (SELECT doc_id, id, type, CASE substring(id, -1) WHEN '0' THEN 'Urteil vom Mai in der Sache' WHEN '1' THEN 'Die § ' || substring(id, 2) || ' Vertrag' WHEN '2' THEN 'Revision' ELSE 'Planet Zorg' END AS name FROM pred),
j AS (SELECT g.name AS gname, g.type AS gtype, p.name AS pname, p.type AS ptype FROM ga g FULL JOIN pa p ON g.doc_id = p.doc_id AND substring(g.id, 2) = substring(p.id, 2) AND substring(g.id, -1) <> '1'),
v AS (SELECT unnest(['baseline', 'drop_anonymised', 'drop_reference_like', 'person_company_only', 'drop_descriptive', 'all_filters_combined (ceiling)']) AS variant),
k AS (SELECT variant, gname IS NOT NULL AND CASE variant WHEN 'drop_anonymised' THEN gname <> 'K.' WHEN 'drop_reference_like' THEN NOT regexp_matches(gname, '[0-9§]') WHEN 'person_company_only' THEN gtype IN ('person', 'company') WHEN 'all_filters_combined (ceiling)' THEN gname <> 'K.' AND NOT regexp_matches(gname, '[0-9§]') ELSE true END AS g,
pname IS NOT NULL AND CASE variant WHEN 'person_company_only' THEN ptype IN ('person', 'company') WHEN 'all_filters_combined (ceiling)' THEN ptype IN ('person', 'company') WHEN 'drop_descriptive' THEN pname NOT LIKE 'Urteil%' ELSE true END AS p FROM j, v)"""


@query("g15_sensitivity", f"WITH {_SENS} SELECT variant, CAST(count(*) FILTER (g AND p) AS BIGINT) AS tp, CAST(count(*) FILTER (p AND NOT g) AS BIGINT) AS fp, CAST(count(*) FILTER (g AND NOT p) AS BIGINT) AS fn FROM k GROUP BY 1")
def g15(spark, d):
    gold, pred, aligned, _ = _named(spark, d)
    return M.sensitivity(gold, pred, aligned)


@query("g16_error_lists", f"WITH {I.LABELLED}, m AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n FROM gold WHERE (doc_id, id) NOT IN (SELECT doc_id, gold_id FROM aligned)) SELECT doc_id, string_agg(id, ',' ORDER BY id) AS missed FROM m WHERE n <= 40 GROUP BY 1")
def g16(spark, d):
    gold, _, aligned = I.labelled(spark, d)
    missed = gold.join(aligned.select("doc_id", F.col("gold_id").alias("id")), ["doc_id", "id"], "left_anti")
    return missed.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("id")), 1, 40), ",").alias("missed"))


@query("g17_headline", f"WITH {I.LABELLED}, {_COUNTS.format(hit='gt = pt')} SELECT 'entity_f1_strict' AS metric, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS value FROM counts UNION ALL SELECT 'typing_accuracy', round(avg(CASE WHEN gt = pt THEN 1.0 ELSE 0.0 END), 6) FROM aligned")
def g17(spark, d):
    a = M.summarise(_counts(spark, d, True)).select(F.lit("entity_f1_strict").alias("metric"), _r("f1", "value"))
    b = M.typing_confusion(*I.labelled(spark, d)).agg(_r(F.sum(F.when(F.col("gold_type") == F.col("pred_type"), F.col("n")).otherwise(0)) / F.sum("n"), "value"))
    return a.unionByName(b.select(F.lit("typing_accuracy").alias("metric"), "value"))


@query("g18_ops_rollup", f"WITH {I.RUNS} SELECT CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_runs, round(sum(cost_usd), 6) AS cost_usd, round(coalesce(sum(cost_usd) FILTER (status <> 'completed'), 0), 6) AS wasted_usd_failed_runs, round(sum(latency_s), 6) AS latency_s FROM runs")
def g18(spark, d):
    rows = ops.roll_up(I.runs(spark, d))
    return rows.select("runs", "failed_runs", *(_r(c, c) for c in ("cost_usd", "wasted_usd_failed_runs", "latency_s")))


@query("g18_stage_seconds", "SELECT event_type AS stage, round(sum(value), 6) AS seconds FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1")
def g18b(spark, d):
    return ops.stage_seconds(I.runs(spark, d)).select("stage", _r("seconds", "seconds"))


@query("g19_efficiency", "SELECT lang, round(sum(doc_id) / count(*), 6) AS usd_per_doc, round(sum(doc_id) * 1000 / sum(n_chars), 6) AS usd_per_1k_chars, round(sum(doc_id) / nullif(count(*) FILTER (n_chars > 500), 0), 6) AS usd_per_correct_entity, round(count(*) * 10 / (sum(n_chars) / 4), 6) AS prompt_tokens_per_doc_token, round(count(*) * 1000 / sum(n_chars), 6) AS s_per_1k_chars, round(sum(doc_id) * 1000 / sum(n_chars) * 900, 6) AS usd_300_pages FROM documents GROUP BY 1")
def g19(spark, d):
    rows = I.table(spark, d, "documents").groupBy("lang").agg(F.sum("doc_id").cast("double").alias("cost"), F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 500).alias("correct"))
    made = rows.select("lang", *ops.efficiency(F.col("cost"), F.col("docs"), F.col("chars"), F.col("correct"), F.col("docs") * 10, F.col("docs")))
    return made.select("lang", *(_r(c, c) for c in made.columns if c != "lang"))


@query("g20_cost_estimate", "SELECT doc_id, round(0.041 + 0.0094 * n_chars / 1000, 6) AS usd, round((0.041 + 0.0094 * n_chars / 1000) * 0.7, 5) AS usd_low FROM documents")
def g20(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id", *ops.cost_estimate(F.col("n_chars")))
    return rows.select("doc_id", _r("usd", "usd"), F.round("usd_low", 5).alias("usd_low"))


@query("g21_engine_telemetry", "SELECT event_type, round(sum(value), 6) AS seconds, round(min(value), 6) AS least, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 ORDER BY 2 DESC")
def g21(spark, d):
    maps = I.table(spark, d, "events").select(F.create_map("event_type", "value").alias("m"))
    return maps.select(F.explode("m").alias("event_type", "v")).groupBy("event_type").agg(_r(F.sum("v"), "seconds"), _r(F.min("v"), "least"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("seconds"))


@query("g22_run_ledger", "SELECT user_id AS run_id, event_type AS model, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (value < 1) AS BIGINT) AS errors, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 10) AS BIGINT) AS completion_tokens, round(sum(value), 6) AS cost_usd FROM events GROUP BY 1, 2")
def g22(spark, d):
    calls = I.table(spark, d, "events").selectExpr("user_id AS run_id", "event_type AS model", "value < 1 AS error", "event_id % 100 AS prompt_tokens", "event_id % 10 AS completion_tokens", "value AS cost_usd")
    return ops.ledger(calls).withColumn("cost_usd", _r("cost_usd"))


@query("g25_type_counts", f"WITH {I.ENTITIES} SELECT doc_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (entity_type = 'person') AS BIGINT) AS persons, CAST(count(*) FILTER (entity_type = 'company') AS BIGINT) AS companies, CAST(count(*) FILTER (entity_type = 'agreement') AS BIGINT) AS agreements, CAST(count(*) FILTER (entity_type NOT IN ('person', 'company', 'agreement')) AS BIGINT) AS others FROM entities GROUP BY 1")
def g25(spark, d):
    is_ = lambda t: F.count_if(F.col("entity_type") == t)
    n = F.count(F.lit(1))
    return I.entities(spark, d).groupBy("doc_id").agg(n.alias("total"), is_("person").alias("persons"), is_("company").alias("companies"), is_("agreement").alias("agreements"), (n - is_("person") - is_("company") - is_("agreement")).alias("others"))


@query("g26_integrity_audit", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL) AS BIGINT) AS missing_key, CAST(count(*) FILTER (event_type = '') AS BIGINT) AS blank_type FROM events")
def g26(spark, d):
    rows = I.table(spark, d, "events").select(F.from_json("props", "k int").alias("p"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p.k").isNull()).alias("missing_key"), F.count_if(F.col("event_type") == "").alias("blank_type"))


@query("g28_dataset_summary", "SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, (SELECT CAST(count(*) AS BIGINT) FROM labels) AS entities FROM documents")
def g28(spark, d):
    n = I.table(spark, d, "labels").agg(F.count(F.lit(1)).alias("entities"))
    return I.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")).crossJoin(n)  # single rows


# --- X ---------------------------------------------------------------------------------------------------------------


def _match_sides(spark, d):
    n = I.names(spark, d)
    gold = n.where("k % 2 = 0").select("doc_id", F.concat(F.lit("g"), F.col("k").cast("string")).alias("id"), "type", F.array("name").alias("forms"))
    pred = n.where("k % 2 = 1").select("doc_id", F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), "type", F.array(F.col("name"), F.upper("name")).alias("forms"))
    return gold, pred


@query("x01_alignment")
def x01(spark, d):
    return M.align(M.similarities(*_match_sides(spark, d))).select("doc_id", "gold_id", "pred_id", _r("score", "score"))


@query("j14_candidate_pairs")
def j14(spark, d):
    return M.similarities(*_match_sides(spark, d)).select("doc_id", "gold_id", "pred_id", _r("score", "score"))


@query("k04_report")
def k04(spark, d):
    """The lines of a report: every second name as a label, the others as predictions, their edges as relations."""
    n = I.names(spark, d).select("k", "doc_id", F.concat(F.lit("E"), F.col("k").cast("string")).alias("id"), "name", "type", F.array(F.concat(F.lit("AR"), F.expr("k div 4"))).alias("aliases"))
    n = n.withColumn("forms", F.concat(F.array("name"), "aliases"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), " met ")
    edges = I.edges(spark, d).withColumn("source", F.regexp_replace("source", "[\\[\\]]", ""))
    sides = [n.where(f"k % 2 = {r}").drop("k") for r in (0, 1)]
    rels = [edges.where(f"pos % 2 = {r}").select("doc_id", "source", "relation", "target") for r in (0, 1)]
    return report.report("names", *sides, n.groupBy("doc_id").agg(text.alias("text")), *rels, replicates=200)


QUERIES["c20_entity_similarity"] = QUERIES["j14_candidate_pairs"]


@query("x02_bootstrap")
def x02(spark, d):
    return M.bootstrap(_counts(spark, d, False).select("doc_id", "tp", "fp", "fn", F.lit(True).alias("precise")), n=200)


def _reports(spark, d):
    rows = I.table(spark, d, "supplier").select(F.col("s_name").alias("metric"), (F.col("s_acctbal") / 10000).alias("value"), "s_suppkey")
    return rows.select("metric", "value"), rows.select(F.expr("CASE WHEN s_suppkey % 3 = 0 THEN concat(metric, ' (new)') ELSE metric END").alias("metric"), (F.col("value") + F.expr("(s_suppkey % 5) / 50.0D")).alias("value"))


_REPORTS = "a AS (SELECT s_name AS metric, s_acctbal / 10000 AS value FROM supplier), b AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' (new)' ELSE s_name END AS metric, s_acctbal / 10000 + (s_suppkey % 5) / 50.0::DOUBLE AS value FROM supplier)"


@query("x03_regression_gate", f"WITH {_REPORTS} SELECT a.metric, round(b.value - a.value, 6) AS fall FROM a JOIN b USING (metric) WHERE b.value - a.value > 0.03")
def x03(spark, d):
    now, before = _reports(spark, d)
    return M.gate(now, before, 0.03, None).select("metric", _r("drop", "fall"))


@query("j16_compare_reports", f"WITH {_REPORTS} SELECT metric, round(a.value, 6) AS a, round(b.value, 6) AS b, round(b.value - a.value, 6) AS delta FROM a JOIN b USING (metric)")
def j16(spark, d):
    return M.compare(*_reports(spark, d)).select("metric", *(_r(c, c) for c in ("a", "b", "delta")))


@query("k10_score_rows", f"WITH {_REPORTS} SELECT substring('run1:' || metric, 1, 120) AS score_id, round(value, 6) AS value FROM a")
def k10(spark, d):
    return ops.score_rows(_reports(spark, d)[0], "run1").select("score_id", _r("value", "value"))


@query("k09_rejects", rf"WITH {_PROPOSALS} SELECT doc_id, q AS exact_quote FROM props WHERE NOT contains(regexp_replace(text, '\s+', ' ', 'g'), regexp_replace(q, '\s+', ' ', 'g'))")
def k09(spark, d):
    p, c = _proposals(spark, d)
    return p.join(c.drop("chunk_id"), "doc_id").where(~F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("exact_quote")))).select("doc_id", "exact_quote")


# --- A: nested sources -----------------------------------------------------------------------------------------------


@query("a07_json_cell", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def a07(spark, d):
    cell = F.when(F.col("event_id") % 1 == 0, F.col("props"))
    return I.table(spark, d, "events").select("event_id", F.from_json(F.coalesce(cell, F.lit("{}")), "k int")["k"].alias("k"))


@query("a08_reference_text", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.text WHEN p.page_id IS NOT NULL THEN p.html ELSE '' END AS text FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def a08(spark, d):
    src = I.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("t"))
    md = I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("m"))
    return src.join(md, "doc_id", "left").select("doc_id", F.coalesce("t", "m", F.lit("")).alias("text"))


_PRED_JSON_S = "concat('{\"entities\":[{\"entity_id\":\"[E', k, ']\",\"canonical_name\":\"', name, '\",\"entity_type\":\"Company\",\"aliases\":[null,\"\",\"', name, '\",\"A', k, '\"],\"citations\":[{\"start_char\":', k % 3, ',\"end_char\":1,\"quote\":\"q\"}]},{\"id\":\"X\",\"name\":\"N\",\"type\":\"per\"}],\"relationships\":[{\"source_entity_id\":\"[E', k, ']\",\"target_entity_id\":\"X\",\"relationship_type\":\"Owned-By\",\"citation\":{\"quote\":\"q\"}}]}')"


@query("a09_predictions", f"WITH {I.NAMES} SELECT k AS doc_id, 'E' || k AS id, name, 'company' AS type, 'A' || k AS aliases, CASE WHEN k % 3 = 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS spans FROM names UNION ALL SELECT k, 'X', 'N', 'person', '', 0 FROM names")
def a09(spark, d):
    raw = I.names(spark, d).select(F.col("k").alias("doc_id"), F.expr(_PRED_JSON_S).alias("json"))
    return loaders.prediction_entities(raw).select("doc_id", "id", "name", "type", F.array_join("aliases", "|").alias("aliases"), F.size("spans").cast("bigint").alias("spans"))


@query("a09_predicted_relations", f"WITH {I.NAMES} SELECT k AS doc_id, 'E' || k AS source, 'owned_by' AS relation, 'X' AS target FROM names")
def a09b(spark, d):
    raw = I.names(spark, d).select(F.col("k").alias("doc_id"), F.expr(_PRED_JSON_S).alias("json"))
    return loaders.prediction_relations(raw).select("doc_id", "source", "relation", "target")


@query("a22_find_run", "SELECT user_id, max_by(event_id, ts) AS run FROM events GROUP BY 1")
def a22(spark, d):
    return I.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("run"))
