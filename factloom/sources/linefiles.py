"""Numbers of a line file's sentences, where its lines are read: a split is numbered alone, and what splits hand on is a row each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

BLANK, MARK, TOKEN = 0, 1, 2

_END = "struct<first_kind:int,lead:int,lead_value:string,last:int,filled:int,q:int,m:int,first:int,begin:int,pos:int,head:string>"
#: Lines with a token, numbered inside their split, and after them a row with the split's end.
NUMBERED = f"path string, split bigint, q int, m int, first int, begin int, pos int, head string, value string, end {_END}"
#: What a split adds to its numbers.
CARRIED = "path string, split bigint, shift int, marks int, known_first int, known_begin int, open int, known_head string"

_KEYS = pa.schema([("path", pa.string()), ("split", pa.int64())])
_NUMBERS = ("q", "m", "first", "begin", "pos")
_END_TYPE = pa.struct([("first_kind", pa.int32()), ("lead", pa.int32()), ("lead_value", pa.string()), ("last", pa.int32()), ("filled", pa.int32()), *((c, pa.int32()) for c in _NUMBERS), ("head", pa.string())])
_ROWS = pa.schema([*_KEYS, *((c, pa.int32()) for c in _NUMBERS), ("head", pa.string()), ("value", pa.string()), ("end", _END_TYPE)])


def _latest(flags: np.ndarray) -> np.ndarray:
    """For each place the last one so far that is set, or -1."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))


class Split:
    """A split as far as it is read: sentences (q) and marked ones (m), the first and last of these, tokens of the open sentence."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        self.first_kind, self.last, self.filled, self.lead, self.lead_value, self.head = None, BLANK, BLANK, BLANK, None, None
        self.q, self.m, self.first, self.begin, self.pos = 0, 0, -1, -1, 0

    def add(self, kind: np.ndarray, value: pa.Array) -> pa.RecordBatch:
        """Rows of the next lines' tokens.  A split's first token starts a sentence here, and no mark is known before it."""
        if self.first_kind is None:
            self.first_kind = int(kind[0])
        filled = kind != BLANK
        if self.lead == BLANK and filled.any():
            at = int(filled.argmax())
            self.lead, self.lead_value = int(kind[at]), value[at].as_py()
        token = kind == TOKEN
        starts = token & (np.concatenate([[self.last], kind[:-1]]) != TOKEN)
        before = np.concatenate([[-1], _latest(filled)[:-1]])
        marked = starts & (np.where(before >= 0, kind[before], self.filled) == MARK)
        q, m = self.q + np.cumsum(starts) - 1, self.m + np.cumsum(marked)
        if self.first < 0 and marked.any():
            self.first = int(q[marked.argmax()])
        from_mark, from_start, seen = _latest(marked), _latest(starts), np.cumsum(token)
        begin = np.where(from_mark >= 0, q[from_mark], self.begin)
        pos = np.where(from_start >= 0, seen - seen[from_start], self.pos + seen - 1)
        heads = pa.concat_arrays([value, pa.array([self.head], value.type)])  # the last is what was known before
        heads = heads.take(pa.array(np.where(from_mark >= 0, from_mark, len(value))))

        keep = np.flatnonzero(token)
        numbers = [pa.array(np.broadcast_to(x, len(kind))[keep].astype(np.int32)) for x in (q, m, self.first, begin, pos)]
        keys = [pa.array([self.path], pa.string()).take(pa.array(np.zeros(len(keep), np.int32))), pa.array(np.full(len(keep), self.split))]
        rows = pa.RecordBatch.from_arrays([*keys, *numbers, heads.take(pa.array(keep)), value.take(pa.array(keep)), pa.nulls(len(keep), _END_TYPE)], schema=_ROWS)

        self.pos = int(seen[-1] - seen[from_start[-1]] + 1 if from_start[-1] >= 0 else self.pos + seen[-1])
        self.q, self.m, self.begin, self.head, self.last = int(q[-1]) + 1, int(m[-1]), int(begin[-1]), heads[-1].as_py(), int(kind[-1])
        if filled.any():
            self.filled = int(kind[_latest(filled)[-1]])
        return rows

    def end(self) -> pa.RecordBatch:
        said = {f.name: getattr(self, f.name) for f in _END_TYPE}
        return pa.RecordBatch.from_pylist([{"path": self.path, "split": self.split, "end": said}], schema=_ROWS)


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (path, split, kind, value), a split's lines in order, to ``NUMBERED``."""
    now: Split | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        path, split = batch.column(0), batch.column(1).to_numpy()
        codes = path.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(split) != 0)) + 1).tolist(), batch.num_rows]
        kind, value = batch.column(2).to_numpy(), batch.column(3).cast(pa.string())
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = (path[lo].as_py(), int(split[lo]))
            if now is None or (now.path, now.split) != key:
                if now is not None:
                    yield now.end()
                now = Split(*key)
            yield now.add(kind[lo:hi], value.slice(lo, hi - lo))
    if now is not None:
        yield now.end()


def carry(ends: list[dict]) -> Iterator[dict]:
    """What each split of one file, in order, adds to its numbers."""
    last, filled, q, m, first, begin, pos, head = BLANK, BLANK, 0, 0, -1, -1, 0, None
    for e in ends:
        joined = e["first_kind"] == TOKEN and last == TOKEN  # its first token goes on with a sentence
        marked = e["lead"] == TOKEN and not joined and filled == MARK
        shift = q - joined
        if marked:
            first, begin, head = (q if first < 0 else first), q, e["lead_value"]
        yield {"shift": shift, "marks": m + marked, "known_first": first, "known_begin": begin, "open": pos if joined else 0, "known_head": head}
        if first < 0 and e["first"] >= 0:
            first = e["first"] + shift
        if e["begin"] >= 0:
            begin, head = e["begin"] + shift, e["head"]
        if e["q"]:
            pos = e["pos"] + (pos if joined and e["q"] == 1 else 0)
        q, m, last, filled = shift + e["q"], m + marked + e["m"], e["last"], e["filled"] or filled


def carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of (path, ends), a file a row with its splits' ends in order, to ``CARRIED``."""
    columns = [c.split()[0] for c in CARRIED.split(", ")]
    for frame in frames:
        rows = [{"path": path, "split": s["split"], **x} for path, ends in zip(frame["path"], frame["ends"], strict=True) for s, x in zip(ends, carry([s["end"] for s in ends]), strict=True)]
        yield pd.DataFrame(rows, columns=columns)
