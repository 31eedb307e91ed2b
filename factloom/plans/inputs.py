"""Inputs that queries derive from the tables, in Spark and, with the same rows, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE = "concat('Aurora ', c_mktsegment, ' ', cast({q} as {s}))"
_NAME = """CASE c_custkey % 8 WHEN 0 THEN {b} WHEN 1 THEN concat({b}, ' GmbH') WHEN 2 THEN concat('The ', {b}, ', Inc.') WHEN 3 THEN concat({b}, ' & Co. KG')
 WHEN 4 THEN lower({b}) WHEN 5 THEN concat({b}, ' Holdings Ltd') WHEN 6 THEN concat(replace({b}, ' ', '-'), ' AG')
 ELSE CASE c_custkey % 3 WHEN 0 THEN concat('Section ', cast(c_custkey as {s})) WHEN 1 THEN concat('$', cast(c_custkey as {s}), ',000') ELSE 'sales personnel' END END"""
_TYPE = "CASE c_custkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'company' WHEN 2 THEN 'agreement' WHEN 3 THEN 'asset' ELSE 'other' END"
_S = {"q": "c_custkey div 4", "s": "string"}
_D = {"q": "c_custkey // 4", "s": "varchar"}


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, doc_id, name, type): spelling variants of made-up company names, four keys a name, 16 a document."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "concat('d', cast(c_custkey div 16 as string)) AS doc_id", f"{_NAME.format(b=_BASE.format(**_S), **_S)} AS name", f"{_TYPE} AS type")


NAMES = f"""names AS (SELECT c_custkey AS k, concat('d', cast(c_custkey // 16 as varchar)) AS doc_id, {_NAME.format(b=_BASE.format(**_D), **_D)} AS name, {_TYPE} AS type FROM customer)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, t): the whole text of each document."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS t")


TEXTS = "texts AS (SELECT doc_id, text AS t FROM documents)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, entity_id, pos, canonical_name, entity_type, aliases, citations): all names, with an alias and two citations."""
    return names(spark, sf_dir).selectExpr(
        "doc_id", "concat('E', cast(k as string)) AS entity_id", "k AS pos", "name AS canonical_name", "type AS entity_type",
        "CASE WHEN k % 3 = 0 THEN array(concat('AR', cast(k div 4 as string))) ELSE cast(array() as array<string>) END AS aliases",
        """array(named_struct('file_id', 'f', 'chunk_id', 0, 'start_char', cast(k % 50 as int), 'end_char', cast(k % 50 + (k % 4) * 5 as int), 'quote', substring(name, 1, 6), 'match', CASE k % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'name_search' ELSE 'unanchored' END),
                 named_struct('file_id', 'f', 'chunk_id', 1, 'start_char', 0, 'end_char', 0, 'quote', '', 'match', 'unanchored')) AS citations""",
    )


ENTITIES = f"""{NAMES},
entities AS (SELECT doc_id, concat('E', cast(k as varchar)) AS entity_id, k AS pos, name AS canonical_name, type AS entity_type,
  CASE WHEN k % 3 = 0 THEN [concat('AR', cast(k // 4 as varchar))] ELSE CAST([] AS VARCHAR[]) END AS aliases,
  k % 50 AS start_char, k % 50 + (k % 4) * 5 AS end_char, substring(name, 1, 6) AS quote, CASE k % 3 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'name_search' ELSE 'unanchored' END AS match
  FROM names)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, relation, target, pos): one to three edges an entity, some dangling, bracketed, looped, unknown or repeated."""
    return names(spark, sf_dir).selectExpr("doc_id", "k", "explode(sequence(0, cast(k % 3 as int))) AS j").selectExpr(
        "doc_id", "CASE WHEN k % 11 = 0 THEN concat('[E', cast(k as string), ']') ELSE concat('E', cast(k as string)) END AS source",
        "CASE (k + j) % 7 WHEN 0 THEN 'controls' WHEN 1 THEN 'governs' WHEN 2 THEN 'participates_in' WHEN 3 THEN 'related_to' WHEN 4 THEN 'represents' WHEN 5 THEN 'transfers_to' ELSE 'owns' END AS relation",
        "CASE WHEN k % 13 = 0 THEN 'ghost' WHEN j = 2 THEN concat('E', cast(k as string)) ELSE concat('E', cast(k + 1 + (j % 2) as string)) END AS target", "k * 4 + j AS pos",
    )


EDGES = """edges AS (SELECT doc_id, CASE WHEN k % 11 = 0 THEN concat('[E', cast(k as varchar), ']') ELSE concat('E', cast(k as varchar)) END AS source,
  CASE (k + j) % 7 WHEN 0 THEN 'controls' WHEN 1 THEN 'governs' WHEN 2 THEN 'participates_in' WHEN 3 THEN 'related_to' WHEN 4 THEN 'represents' WHEN 5 THEN 'transfers_to' ELSE 'owns' END AS relation,
  CASE WHEN k % 13 = 0 THEN 'ghost' WHEN j = 2 THEN concat('E', cast(k as varchar)) ELSE concat('E', cast(k + 1 + (j % 2) as varchar)) END AS target, k * 4 + j AS pos
  FROM (SELECT doc_id, k, unnest(generate_series(0, k % 3)) AS j FROM names))"""


def gold_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, relation, target): order lines, a document a block of orders."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey div 1000 as string) AS doc_id", "concat('o', cast(l_orderkey as string)) AS source", "l_returnflag AS relation", "concat('p', cast(l_partkey as string)) AS target", "l_linenumber AS n", "l_partkey AS p"
    )


def pred_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every fifth dropped, every seventh reversed and every eleventh retyped."""
    return gold_relations(spark, sf_dir).where("p % 5 <> 0").selectExpr(
        "doc_id", "CASE WHEN p % 7 = 0 THEN target ELSE source END AS source", "CASE WHEN p % 11 = 0 THEN 'X' ELSE relation END AS relation", "CASE WHEN p % 7 = 0 THEN source ELSE target END AS target"
    )


RELATIONS = """gold AS (SELECT cast(l_orderkey // 1000 as varchar) AS doc_id, concat('o', cast(l_orderkey as varchar)) AS source, l_returnflag AS relation, concat('p', cast(l_partkey as varchar)) AS target, l_partkey AS p
  FROM lineitem),
pred AS (SELECT doc_id, CASE WHEN p % 7 = 0 THEN target ELSE source END AS source, CASE WHEN p % 11 = 0 THEN 'X' ELSE relation END AS relation, CASE WHEN p % 7 = 0 THEN source ELSE target END AS target FROM gold WHERE p % 5 <> 0)"""


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, pred, aligned) entities from labels: a rule predicts every document but those with id mod 7 = 0, and extras without a label."""
    lab, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    gold = lab.selectExpr("cast(doc_id div 10 as string) AS doc_id", "concat('g', cast(doc_id as string)) AS id", "CASE WHEN toxic = 1 THEN 'person' WHEN quality = 1 THEN 'company' ELSE 'asset' END AS type")
    pred = docs.where("doc_id % 7 <> 0").selectExpr("cast(doc_id div 10 as string) AS doc_id", "concat('p', cast(doc_id as string)) AS id", "CASE WHEN n_chars < 400 THEN 'asset' WHEN lang = 'fr' THEN 'person' ELSE 'company' END AS type")
    aligned = gold.join(pred.selectExpr("doc_id", "id AS pred_id", "substring(id, 2) AS i"), ["doc_id"]).where("substring(id, 2) = i").selectExpr("doc_id", "id AS gold_id", "pred_id", "1.0D AS score")
    return gold, pred, aligned


LABELLED = """gold AS (SELECT cast(doc_id // 10 as varchar) AS doc_id, concat('g', cast(doc_id as varchar)) AS id, CASE WHEN toxic = 1 THEN 'person' WHEN quality = 1 THEN 'company' ELSE 'asset' END AS type FROM labels),
pred AS (SELECT cast(doc_id // 10 as varchar) AS doc_id, concat('p', cast(doc_id as varchar)) AS id, CASE WHEN n_chars < 400 THEN 'asset' WHEN lang = 'fr' THEN 'person' ELSE 'company' END AS type FROM documents WHERE doc_id % 7 <> 0),
aligned AS (SELECT g.doc_id, g.id AS gold_id, p.id AS pred_id, g.type AS gt, p.type AS pt FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND substring(g.id, 2) = substring(p.id, 2))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, status, cost_usd, latency_s, stages_s): events as a run ledger, a user a run."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*_run_columns()).selectExpr("user_id AS run_id", "status", "cost_usd", "latency_s", "stages_s")


def _run_columns():
    from pyspark.sql import functions as F

    kinds = ("view", "click", "signup", "purchase")
    stages = F.create_map(*(x for k in kinds for x in (F.lit(k), F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)))))
    errors = F.count_if(F.col("event_type") == "error")
    return [
        F.when(errors > 15, "failed").when(errors > 12, "running").otherwise("completed").alias("status"),
        F.sum("value").alias("cost_usd"),
        F.count(F.lit(1)).cast("double").alias("latency_s"),
        stages.alias("stages_s"),
    ]


RUNS = """runs AS (SELECT user_id AS run_id, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 15 THEN 'failed' WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 12 THEN 'running' ELSE 'completed' END AS status,
  sum(value) AS cost_usd, CAST(count(*) AS DOUBLE) AS latency_s FROM events GROUP BY 1)"""
