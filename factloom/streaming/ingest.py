"""Structured Streaming ingest of uploaded texts: an extension, as the batch sources cover the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunk


def stream_chunks(spark: SparkSession, landing: str, target: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Each new text file's paragraph chunks, appended to a Parquet table; runs until all landed files are read."""
    source = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(landing)
    docs = source.select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        chunk.chunks(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_costs(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Cost and calls a window and kind of a stream (or table) of events with ts, event_type and value."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("cost")).select(F.col("w.start").alias("start"), "event_type", "calls", "cost")
