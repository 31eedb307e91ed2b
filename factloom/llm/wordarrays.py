"""Vectorised tokenisation of Arrow text columns.

A whole Arrow column is treated as one byte buffer.  Words are maximal runs of "word bytes"; each gets a 64-bit
polynomial hash computed with prefix sums, so no Python code runs per word.  Nulls count as empty texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 17
_U = np.uint64


def _table(is_word) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if is_word(b):
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Words are runs of anything but ASCII white space; A-Z count as a-z.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z.
ALNUM = _table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, _INV, dtype=_U)
        up[0] = down[0] = 1
        tables = np.cumprod(up), np.cumprod(down)
        if size > 8 * _CHUNK:
            return tables
        _powers[size] = tables
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of all rows: hash, byte range in ``data``, and ``first[i]:first[i + 1]`` are those of row i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def folded(self, i: int, j: int, table: np.ndarray) -> bytes:
        """Words i..j-1 of one row, folded by ``table`` and joined by zero bytes."""
        return b"\0".join(table[self.data[s:e]].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_LETTER = np.array([97 <= b <= 122 for b in range(256)])
_SIGN = np.array([33 <= b < 127 and b != 39 and not chr(b).isalnum() for b in range(256)])


def words_of(column: pa.Array, table: np.ndarray, split_signs: bool = False) -> Words:
    """Tokenise a column; working memory beyond the words themselves is a few MB, whatever the length of a text.

    With ``split_signs`` a word also ends between an ASCII letter and an ASCII sign other than the apostrophe.
    """
    data, bounds = column_bytes(column)
    hashes, starts, ends = [], [], []
    at, size = 0, len(data)
    while at < size:
        stop = min(at + _CHUNK, size)
        if stop < size:  # end the block after a separator or at a row's start, else grow it
            block = table[data[at:stop]]
            gaps = np.flatnonzero(block == 0)
            row = bounds[np.searchsorted(bounds, stop, side="right") - 1]
            cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, int(row))
            if cut <= at:
                later = np.flatnonzero(table[data[stop:]] == 0)
                nxt = bounds[min(np.searchsorted(bounds, stop, side="left"), len(bounds) - 1)]
                cut = min(stop + int(later[0]) + 1 if len(later) else size, int(nxt) if nxt > at else size)
            stop = cut
        folded = table[data[at:stop]]
        inside = folded != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        rows = bounds[np.searchsorted(bounds, at, side="right") : np.searchsorted(bounds, stop, side="left")] - at
        rows = rows[(rows > 0) & (rows < stop - at)]
        first[rows] = inside[rows]
        last[rows - 1] = inside[rows - 1]
        if split_signs:
            edge = np.flatnonzero(_SIGN[folded[1:]] & _LETTER[folded[:-1]])
            first[edge + 1] = last[edge] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_tables(stop - at + 1)
        sums = np.zeros(stop - at + 1, dtype=_U)
        np.cumsum(folded.astype(_U) * up[: stop - at], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    begin = cat(starts, np.int64)
    return Words(cat(hashes, _U), begin, cat(ends, np.int64), np.searchsorted(begin, bounds, side="left"), data, bounds)


def windows_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``size`` consecutive words, across rows too; the caller masks those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, dtype=_U)
    for j in range(size):
        out *= _U(0x9FB21C651E98DF25)
        out += hashes[j : j + n]
    return mix(out)


def row_windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of windows of ``size`` words within rows, first window of each row as n + 1 offsets).

    A row of fewer words, but not none, has one window: all its words.
    """
    counts = np.diff(words.first)
    n_win = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n_win)])
    out = np.zeros(first[-1], dtype=_U)
    every = windows_hash(words.hashes, size)
    full = counts >= size
    if full.any():
        n_full = n_win[full]
        within = np.arange(n_full.sum()) - np.repeat(np.cumsum(n_full) - n_full, n_full)
        out[np.repeat(first[:-1][full], n_full) + within] = every[np.repeat(words.first[:-1][full], n_full) + within]
    for i in np.flatnonzero((counts > 0) & ~full):
        part = words.hashes[words.first[i] : words.first[i + 1]]
        out[first[i]] = windows_hash(part, len(part))[0] ^ _U(len(part))
    return out, first
