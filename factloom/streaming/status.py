"""Status of runs as a state machine over a stream of what happens to them.

A run is pending until an output is there (completed, for good) or its ledger says that it failed (an output may still come).  A
run that is pending ``limit`` after its first event has failed too.  Its state goes with that timer, so what is kept are
the runs of the last ``limit``; rows later than the watermark are left out.

Runs are very many and have few events each, so runs are kept by bucket: a call, a state and a timer serve all runs of a bucket.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANKS = {"pending": 0, "failed": 1, "completed": 2}
TIMED_OUT = "no end within the limit"

#: What stands for an event without a time, in microseconds: before all others as a time, but the last of its run's events.
NO_TIME = -9_223_372_036_854_776


class RunStatus(StatefulProcessor):
    """A bucket of runs: every change of status or error is a row (run_id, us, status, error)."""

    def __init__(self, limit_ms: int, run_id: DataType):
        self.limit_ms = limit_ms
        run = StructType().add("run_id", run_id).add("status", StringType()).add("error", StringType()).add("error_ms", LongType()).add("deadline", LongType())
        self.schema = StructType().add("runs", ArrayType(run)).add("timer", LongType())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", self.schema)

    def _known(self) -> tuple[dict, int | None]:
        """The bucket's runs and when its timer ends."""
        if not self.state.exists():
            return {}, None
        runs, timer = self.state.get()
        return {run_id: tuple(rest) for run_id, *rest in runs}, timer

    def _keep(self, runs: dict, timer: int | None) -> None:
        """The runs and a timer for the first that ends."""
        if not runs:
            self.state.clear()
            return
        first = min(deadline for *_, deadline in runs.values())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.state.update(([(run_id, *rest) for run_id, rest in runs.items()], first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        events = defaultdict(list)
        for frame in rows:
            # a column with nulls would be one of fractions: runs without an id have a bucket of their own
            ids = [None] * len(frame) if key[0] < 0 else frame["run_id"].tolist()
            for run_id, *event in zip(ids, frame["us"].tolist(), frame["has_output"].tolist(), frame["said"].tolist(), frame["why"].tolist(), strict=True):
                events[run_id].append(event)
        runs, timer = self._known()
        out = []
        for run_id, mine in events.items():
            mine.sort(key=lambda e: (e[0] == NO_TIME, e[0]))
            known = run_id in runs
            status, error, error_ms, deadline = runs[run_id] if known else ("pending", None, None, mine[0][0] // 1000 + self.limit_ms)
            if not known:
                out.append((run_id, mine[0][0], status, error))
            for us, has_output, said, why in mine:
                ms, before = us // 1000, (status, error)
                if has_output:
                    status, error = "completed", None
                elif said == "failed" and status != "completed" and (error_ms is None or ms >= error_ms):
                    status, error, error_ms = "failed", why, ms
                if (status, error) != before:
                    out.append((run_id, us, status, error))
            runs[run_id] = (status, error, error_ms, deadline)
        self._keep(runs, timer)
        yield self._changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        until = max(now, timerValues.getCurrentWatermarkInMs() - 1)  # the other runs that end by then have no timer
        runs, timer = self._known()
        out = [(run_id, deadline * 1000, "failed", TIMED_OUT) for run_id, (status, _, _, deadline) in runs.items() if deadline <= until and status == "pending"]
        self._keep({run_id: run for run_id, run in runs.items() if run[-1] > until}, None if timer == now else timer)
        yield self._changes(out)

    @staticmethod
    def _changes(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([row[i] for row in out], dtype="int64" if c == "us" else object) for i, c in enumerate(("run_id", "us", "status", "error"))})

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, limit_seconds: int = 86_400, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Stream of (run_id, at, status, error) from one of (run_id, ts, has_output, ops_status, ops_error).

    A batch reads and writes the state of the buckets that it has events of; the number of ``buckets`` stays that of the stream's first start.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.select("run_id", F.col("ts").cast("timestamp").alias("ts"), "has_output", F.col("ops_status").alias("said"), F.when(F.col("ops_status") == "failed", F.col("ops_error")).alias("why")).withWatermark("ts", late)
    bucket = F.when(F.col("run_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
    rows = rows.select(bucket.alias("bucket"), "run_id", "ts", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("us"), "has_output", "said", "why")
    run_id = events.schema["run_id"].dataType
    schema = StructType().add("run_id", run_id).add("us", LongType()).add("status", StringType()).add("error", StringType())
    changes = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=RunStatus(limit_seconds * 1000, run_id), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    at = F.when(F.col("us") != NO_TIME, F.timestamp_micros("us"))
    return changes.select("run_id", at.alias("at"), "status", "error")


def latest_status(changes: DataFrame) -> DataFrame:
    """(run_id, status, error) as of all changes so far: an output counts most, then the latest failure."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), F.col("status"))
    best = F.max_by(F.struct("status", "error"), F.struct(rank, "at"))
    return changes.groupBy("run_id").agg(best.alias("x")).select("run_id", "x.status", "x.error")
