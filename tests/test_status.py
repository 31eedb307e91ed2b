"""The state machine of runs: replayed files, runs that never end, late rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.operators import ops
from factloom.streaming import status

SCHEMA = "run_id string, ts timestamp, has_output boolean, ops_status string, ops_error string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def replay(spark, tmp_path):
    def run(batches, **options):
        """Files one after another; all changes."""
        for i, rows in enumerate(batches):
            spark.createDataFrame([(r, START + dt.timedelta(seconds=s), *x) for r, s, *x in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
        source = None
        changes = []
        for i in range(len(batches)):  # a folder a batch: the same query goes on from its checkpoint
            for f in (tmp_path / f"in{i}").glob("part-*"):
                (tmp_path / "landing").mkdir(exist_ok=True)
                f.rename(tmp_path / "landing" / f"{i}-{f.name}")
            source = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/landing")
            query = status.status_changes(source, **options).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            changes = spark.read.parquet(f"file://{tmp_path}/out")
        return changes

    return run


def test_replayed_runs_have_the_status_of_their_files(spark, replay):
    out, fail, none = (True, None, None), (False, "failed", "boom"), (False, "running", None)
    batches = [[("a", 0, *none), ("b", 1, *fail), ("c", 2, *none), ("d", 3, *fail)], [("a", 10, *out), ("b", 11, *none), ("d", 12, *out), ("e", 13, *none), ("a", 14, *fail)]]
    changes = replay(batches)
    got = {r.run_id: (r.status, r.error) for r in status.latest_status(changes).collect()}
    rows = spark.createDataFrame([(r, *x) for b in batches for r, _, *x in b], "run_id string, has_output boolean, ops_status string, ops_error string")
    files = rows.groupBy("run_id").agg(F.bool_or("has_output").alias("has_output"), F.max(F.when(F.col("ops_status") == "failed", "failed")).alias("ops_status"), F.max("ops_error").alias("ops_error"))
    assert got == {r.run_id: (r.status, r.error) for r in ops.run_status(files).collect()}
    assert changes.where("run_id = 'a'").count() == 2 and changes.where("run_id = 'd'").count() == 3


def test_runs_that_never_end_fail_and_late_rows_are_left_out(replay):
    none, out = (False, "running", None), (True, None, None)
    batches = [[("a", 0, *none), ("b", 0, *none)], [("b", 50, *out), ("c", 1_000, *none)], [("d", 1_001, *none)], [("late", 1, *none), ("d", 1_002, *out)]]
    changes = replay(batches, limit_seconds=100, late="10 seconds")
    got = {r.run_id: (r.status, r.error) for r in status.latest_status(changes).collect()}
    assert got == {"a": ("failed", status.TIMED_OUT), "b": ("completed", None), "c": ("pending", None), "d": ("completed", None)}


def test_runs_of_one_bucket_end_each_at_its_own_time(replay):
    none, out, fail = (False, "running", None), (True, None, None), (False, "failed", "boom")
    batches = [[("a", 0, *none), (None, 5, *none), ("e", 30, *none), ("f", 20, *fail)], [("a", 0, *none), ("g", 115, *out)], [("h", 120, *none)], [("e", 125, *out), ("i", 1_000, *none)], [("j", 1_001, *none)]]
    changes = replay(batches, limit_seconds=100, late="10 seconds", buckets=1)
    ended = {r.run_id: (r.at - START).total_seconds() for r in changes.where(F.col("error") == status.TIMED_OUT).collect()}
    assert ended == {"a": 100, None: 105, "h": 220}
    got = {r.run_id: (r.status, r.error) for r in status.latest_status(changes).collect()}
    assert got == {"a": ("failed", status.TIMED_OUT), None: ("failed", status.TIMED_OUT), "e": ("completed", None), "f": ("failed", "boom"), "g": ("completed", None), "h": ("failed", status.TIMED_OUT), "i": ("pending", None), "j": ("pending", None)}
    assert changes.where("run_id = 'a'").count() == 2
