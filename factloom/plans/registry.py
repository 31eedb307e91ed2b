"""All queries of the register engine by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries, metric_queries, run_queries, source_queries, structure_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, structure_queries, metric_queries, file_queries, run_queries, source_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored benchmark quotes by language of their document, each verified against its slice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    quotes = QUERIES["j05_quote_anchor"](spark, sf_dir)
    rows = docs.join(quotes, "doc_id", "left").groupBy("lang")
    return rows.agg(F.countDistinct("doc_id").alias("n_docs"), F.count("item_id").alias("n_quotes"), F.count_if(F.coalesce("verified", F.lit(False))).alias("n_verified"))


QUERIES["m0_flagship"] = flagship
ORACLE_SQL["m0_flagship"] = """WITH p AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT lang, CAST(count(DISTINCT d.doc_id) AS BIGINT) AS n_docs, CAST(count(item_id) AS BIGINT) AS n_quotes, CAST(count(item_id) AS BIGINT) AS n_verified FROM documents d LEFT JOIN p USING (doc_id) GROUP BY 1"""
