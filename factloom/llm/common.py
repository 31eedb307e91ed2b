"""Session helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.shared import shared_dir, shared_path

__all__ = ["blocks", "cut", "lean", "list_array", "per_batch", "per_block", "require", "shared_dir", "shared_path"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` followed by handing free memory back, as Spark keeps Python workers alive for later tasks."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return body


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable[[Iterator], Iterator]:
    """Lift a function of one record batch to mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return lean(run)


def blocks(batch: pa.RecordBatch, column: str, block_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of a batch with about ``block_bytes`` in ``column`` each; an empty batch is one slice."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while True:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_bytes, side="right"))) if len(ends) else 0
        yield batch.slice(at, stop - at)
        at = stop
        if at >= batch.num_rows:
            return


def per_block(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, block_bytes: int = 4 << 20) -> Callable[[Iterator], Iterator]:
    """Lift a function of a record batch to mapInArrow, a bounded number of bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, column, block_bytes):
                yield fn(block)

    return lean(run)


def list_array(values: pa.Array, offsets) -> pa.Array:
    """A list column from its flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
