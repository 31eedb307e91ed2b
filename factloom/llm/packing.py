"""Sequence packing by best-fit decreasing, with exact token coverage.

Documents are tokenised where they are read and packed in blocks of about ``block_tokens`` tokens, so there is no
shuffle and a task holds one block.  Overlong documents are first cut into full windows.  The rest go, longest first,
into the open window with the least room that still takes them; a segment tree over remaining capacities finds it.
Windows left with more than ``max_slack`` free places are closed at the end of a block: the emptiest are cut to fill
the others, and what then remains is cut into sequences whose lengths are powers of two, which need no padding.

Each distinct segment is tokenised once and kept in a bounded table.  Segments end at ASCII white space and between an
ASCII letter and a sign, where the pre-tokenizer of ``word_bpe_49k.json`` splits too, so the ids are those of whole
texts; texts that spell one of its special tokens are tokenised whole.

Defined results: a null or empty text is the end token alone; rows that repeat an id are packed as documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import lean, require

_tables: dict[str, WordTable] = {}
_SPECIAL = "oftext|>"


class WordTable:
    """Token ids of text segments, each tokenised once while the table has room for it."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, segments: list[str]) -> None:
        """``keys`` are sorted."""
        flat, ends = [self.flat], [self.ends]
        for at in range(0, len(segments), 8192):
            made = [e.ids for e in self.tokenizer.encode_batch_fast(segments[at : at + 8192], add_special_tokens=False)]
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            flat.append(np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum())))
            ends.append(ends[-1][-1] + np.cumsum(lengths))
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.rows = np.insert(self.rows, place, np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(keys), dtype=np.int32))
        self.flat, self.ends = np.concatenate(flat), np.concatenate(ends)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1).astype(np.int64)

    def encode(self, column: pa.Array, block_bytes: int = 3 << 20) -> Iterator[np.ndarray]:
        """Ids of each text; the same as of whole texts, as segments end where the pre-tokenizer splits anyway."""
        _, bounds = wa.column_bytes(column)
        at, n = 0, len(column)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block_bytes, side="right")) - 1)
            yield from self._encode(column.slice(at, stop - at))
            at = stop

    def _encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        words = wa.words_of(column, wa.SPACED, split_signs=True)
        special = set(np.flatnonzero(pc.match_substring(column, _SPECIAL, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)))
        unique, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.rows) > self.most:
            self._clear()
        known = self._find(unique)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            where = at[missing]
            self._learn(unique[missing], [wa.SPACED[words.data[s:e]].tobytes().decode("utf-8", "replace") for s, e in zip(words.starts[where], words.ends[where], strict=True)])
            known = self._find(unique)
        row = known[inverse]
        start, length = self.ends[row], self.ends[row + 1] - self.ends[row]
        step, n = 256, len(words.first) - 1
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = words.first[lo], words.first[hi]
            size = length[a:b]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(start[a:b] - upto[:-1], size) + np.arange(upto[-1])]
            for i in range(lo, hi):
                if i in special:
                    yield np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[upto[words.first[i] - a] : upto[words.first[i + 1] - a]]


def _table(path: str | None) -> WordTable:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


class CapacityTree:
    """Open windows by remaining capacity; ``tightest(n)`` is the least capacity of at least n that any has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: dict[int, list[int]] = defaultdict(list)

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, room: int) -> int:
        i = room + self.size
        while i:
            self.counts[i] -= 1
            i >>= 1
        return self.open[room].pop()

    def tightest(self, need: int) -> int | None:
        counts, i = self.counts, need + self.size
        if counts[i]:
            return need
        while i > 1:
            if not i & 1 and counts[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i <<= 1
            if not counts[i]:
                i += 1
        return i - self.size


def pack_lengths(lengths: list[int], window: int, max_slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover every document of ``lengths`` exactly once."""
    done, rest = [], []
    for d, n in enumerate(lengths):
        full = n // window * window
        done += [[(d, at, window)] for at in range(0, full, window)]
        if n > full:
            rest.append((n - full, d, full))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, windows = CapacityTree(window), []
    for n, d, at in rest:
        room = tree.tightest(n)
        if room is None:
            windows.append([])
            room, w = window, len(windows) - 1
        else:
            w = tree.take(room)
        windows[w].append((d, at, n))
        if room > n:
            tree.add(room - n, w)
    fill = [sum(p[2] for p in w) for w in windows]
    done += [w for w, f in zip(windows, fill, strict=True) if window - f <= max_slack]
    loose = sorted((f, w) for w, f in enumerate(fill) if window - f > max_slack)
    pieces: list[tuple[int, int, int]] = []
    i, j = 0, len(loose) - 1
    while i <= j:
        if not pieces:
            pieces = list(reversed(windows[loose[i][1]]))
            i += 1
            continue
        room, target = window - loose[j][0], windows[loose[j][1]]
        while room and (pieces or i < j):
            if not pieces:
                pieces = list(reversed(windows[loose[i][1]]))
                i += 1
            d, at, n = pieces.pop()
            part = min(n, room)
            target.append((d, at, part))
            room -= part
            if part < n:
                pieces.append((d, at + part, n - part))
        if room:  # no donor is left
            pieces = list(reversed(target))
        else:
            done.append(target)
        j -= 1
    pieces.reverse()
    left = sum(p[2] for p in pieces)
    while left:
        size, seq = 1 << min(window, left).bit_length() - 1, []
        left -= size
        while size:
            d, at, n = pieces.pop(0)
            part = min(n, size)
            seq.append((d, at, part))
            size -= part
            if part < n:
                pieces.insert(0, (d, at + part, n - part))
        done.append(seq)
    return done


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer_path: str | None = None, window=4096, end_id=2, max_slack=8, block_tokens=6_000_000) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset."""
    require(docs, id_col, text_col)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        table = _table(tokenizer_path)
        ids: list[int] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            cols: list[list] = [[] for _ in range(7)]
            weight = 0
            for seq in pack_lengths([len(t) // 4 for t in tokens], window, max_slack):
                offset = 0
                for d, at, n in seq:
                    for col, value in zip(cols, (ids[d], at, n, tokens[d][4 * at : 4 * (at + n)], len(tokens[d]) // 4, sequence, offset), strict=True):
                        col.append(value)
                    offset += n
                sequence += 1
                weight += offset
                if weight > 1_000_000:
                    yield _batch(cols)
                    cols, weight = [[] for _ in range(7)], 0
            if cols[0]:
                yield _batch(cols)
            ids.clear()
            tokens.clear()
            held = 0

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), table.encode(batch.column(1)), strict=True):
                made = found.astype("<u4").tobytes() + end
                ids.append(key)
                tokens.append(made)
                held += len(made) // 4
                if held >= block_tokens:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), SCHEMA)


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary() if i == 3 else pa.int64() for i in range(7)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
