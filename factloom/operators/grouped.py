"""Whole groups in Arrow batches: many small groups in one call, in place of one call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that no group spans, of rows that come sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        group = frame.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        if held:
            last = held[-1].iloc[[-1]]
            same = pd.concat([last, frame.iloc[[0]]]).groupby(keys, dropna=False).ngroup().nunique() == 1
            if not same:
                yield pd.concat(held, ignore_index=True)
                held = []
            elif group[-1] != group[0]:
                head = int((group == group[0]).sum())
                yield pd.concat([*held, frame.iloc[:head]], ignore_index=True)
                held, frame, group = [], frame.iloc[head:], group[head:]
        tail = int((group != group[-1]).sum())
        if tail and not held:
            yield frame.iloc[:tail].reset_index(drop=True)
        held.append(frame.iloc[tail:] if not held else frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def map_groups(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over frames of whole groups of ``keys``, sorted by keys and ``order``; a frame has many groups."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            yield run(frame)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)
