"""Run ledger roll-ups, efficiency figures and run listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars a document and a thousand characters, and the stated spread.
PER_DOCUMENT, PER_1K_CHARS, SPREAD = 0.041, 0.0094, 0.3


def ledger(calls: DataFrame) -> DataFrame:
    """(run_id, model, calls, errors, tokens, cost) from a table of calls."""
    return calls.groupBy("run_id", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd")
    )


def roll_up(runs: DataFrame) -> DataFrame:
    """One row: runs, failed runs, cost, cost of runs that didn't complete, latency."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.sum("cost_usd").alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("status") != "completed", F.col("cost_usd"))), F.lit(0.0)).alias("wasted_usd_failed_runs"),
        F.sum("latency_s").alias("latency_s"),
    )


def stage_seconds(runs: DataFrame, stages: str = "stages_s") -> DataFrame:
    """(stage, seconds) summed over runs."""
    return runs.select(F.explode(stages).alias("stage", "s")).groupBy("stage").agg(F.sum("s").alias("seconds"))


def efficiency(cost: Column, docs: Column, chars: Column, correct: Column, prompt_tokens: Column, seconds: Column) -> list[Column]:
    """Dollars a document, a thousand characters and a correct entity; prompt tokens a text token; seconds; a 300-page projection."""
    per_1k = F.try_divide(cost * 1000, chars)
    return [
        F.try_divide(cost, docs).alias("usd_per_doc"),
        per_1k.alias("usd_per_1k_chars"),
        F.try_divide(cost, correct).alias("usd_per_correct_entity"),
        F.try_divide(prompt_tokens, chars / 4).alias("prompt_tokens_per_doc_token"),
        F.try_divide(seconds * 1000, chars).alias("s_per_1k_chars"),
        (per_1k * 900).alias("usd_300_pages"),
    ]


def cost_estimate(chars: Column) -> list[Column]:
    mid = F.lit(PER_DOCUMENT) + PER_1K_CHARS * chars / 1000
    return [mid.alias("usd"), (mid * (1 - SPREAD)).alias("usd_low"), (mid * (1 + SPREAD)).alias("usd_high")]


def run_status(runs: DataFrame) -> DataFrame:
    """completed with an output, failed with its error where the ledger says so, else pending."""
    status = F.when(F.col("has_output"), "completed").when(F.col("ops_status") == "failed", "failed").otherwise("pending")
    return runs.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", F.col("ops_error")))


def latest(rows: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """The newest row's id, of several the largest."""
    return rows.agg(F.max_by(id_col, F.struct(time_col, id_col)).alias(id_col))


def last_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in ascending order."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def score_rows(report: DataFrame, run_id: str) -> DataFrame:
    """(score_id, metric, value) of numeric metrics, with ids that don't change from one push to the next."""
    return report.where("value is not null").select(F.substring(F.concat_ws(":", F.lit(run_id), "metric"), 1, 120).alias("score_id"), "metric", "value")
