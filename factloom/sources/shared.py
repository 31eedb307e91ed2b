"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if base is None and current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if current is None:
        spark.sparkContext.setCheckpointDir(base)
    return (base or current).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in the shared folder, bucketed and sorted by ``keys``: joins and groups by these keys, or by more, don't move them again."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # else joins by more keys than these would move both sides
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"factloom_{uuid.uuid4().hex}"
    rows = df.repartition(n, *keys).write.bucketBy(n, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    rows.option("compression", "zstd").option("path", shared_path(spark, "laid")).saveAsTable(name)
    return spark.table(name)


def kept(df: DataFrame) -> DataFrame:
    """The rows as files of columns in the shared folder, where they are: readers of some columns don't read the others."""
    path = shared_path(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
