"""Importance resampling towards a target distribution of hashed word n-grams, without replacement.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z.  Features are all runs of 1 to 3 consecutive words
joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``.  One pass counts the buckets of all documents and
of the target's texts; a bucket's gain is floor(1000 ln of the ratio of its smoothed shares).  A second pass sums gains over
each document's features, as arrays: CRCs of n-grams follow from those of their words, since appending a word is linear
over the register.  A Gumbel term from a hash of the id makes the highest scores a draw without replacement.

Rows of at least ``min_words`` words can be drawn.  Each stored partition sorts its own into a run and cuts it at splitters
taken from a sample; the pieces are stored.  The sizes of the ranges tell which range holds the last rank of the draw:
ranges before and up to it are merged, a range in a task, by a tournament tree over the runs, which stops at the exact
count; later ranges are never merged.  The order is by score, id, and the row's number, so any range can be divided,
whatever repeats.

Defined results: null texts have no features and weight 0; rows that repeat an id are documents of their own, which share
the Gumbel term and take ranks one after the other if their weights are equal; null ids come before others of the same
score; an empty target has no counts (gains then even out what is frequent); empty tables give no rows; ids are whole
numbers; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import blocks, cut, lean, require

_U4 = np.uint32
_ONES = 0xFFFFFFFF
#: Words of more bytes than this are advanced one at a time.
_LONGEST = 64


def _register() -> np.ndarray:
    """The register after one byte b from zero, for every b."""
    return np.array([zlib.crc32(bytes([b]), _ONES) ^ _ONES for b in range(256)], _U4)


_STEP = _register()


def _zeros() -> np.ndarray:
    """[n, k, b]: the register after n zero bytes, from b in its byte k."""
    out = np.empty((_LONGEST + 2, 4, 256), _U4)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=_U4) << _U4(8 * k)
    for n in range(1, len(out)):
        out[n] = _STEP[out[n - 1] & _U4(255)] ^ (out[n - 1] >> _U4(8))
    return out


_ZEROS = _zeros()
_FLAT = _ZEROS.reshape(-1)


def _after(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` zero bytes each."""
    base = length.astype(np.int64) * 1024
    out = _FLAT[base + (register & _U4(255))]
    for k in range(1, 4):
        out ^= _FLAT[base + (256 * k) + ((register >> _U4(8 * k)) & _U4(255))]
    return out


def ngram_crcs(words: wa.Words, folded: np.ndarray) -> list[np.ndarray]:
    """CRC-32 of every run of 1, 2 and 3 words by its first word, across rows too; runs past the end are short arrays."""
    starts, lengths = words.starts, words.ends - words.starts
    n = len(starts)
    own = np.zeros(n, _U4)  # the register after a word alone, from zero
    short = np.minimum(lengths, _LONGEST)
    order = np.argsort(-short.astype(np.int16), kind="stable")
    begin, active = starts[order], np.searchsorted(-short[order], -np.arange(_LONGEST), side="left")
    state = np.zeros(n, _U4)
    for j in range(_LONGEST):
        m = active[j]
        if not m:
            break
        state[:m] = _STEP[(state[:m] ^ folded[begin[:m] + j]) & _U4(255)] ^ (state[:m] >> _U4(8))
    own[order] = state
    long = np.flatnonzero(lengths > _LONGEST)
    spelled = {int(i): folded[starts[i] : words.ends[i]].tobytes() for i in long}
    for i, word in spelled.items():
        own[i] = zlib.crc32(word, _ONES) ^ _ONES
    at = np.where(lengths > _LONGEST, 0, lengths)
    tails = _after(np.full(n, _STEP[32], _U4), at) ^ own  # after a space and the word, from zero
    now = _after(np.full(n, _ONES, _U4), at) ^ own
    for i, word in spelled.items():
        now[i] = zlib.crc32(word) ^ _ONES
    out = [now ^ _U4(_ONES)]
    for size in (1, 2):
        if n <= size:
            out.append(np.zeros(0, _U4))
            continue
        before = now[: n - size]
        now = _after(before, at[size:] + 1) ^ tails[size:]
        for i, word in spelled.items():
            if i >= size:
                now[i - size] = zlib.crc32(b" " + word, int(before[i - size]) ^ _ONES) ^ _ONES
        out.append(now ^ _U4(_ONES))
    return out


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(n + 1 offsets of words by row, (first words, buckets) of the runs of 1, 2 and 3 words that lie within rows)."""
    words = wa.words_of(texts, wa.ALNUM)
    rows, out = words.row_of(), []
    for size, crcs in enumerate(ngram_crcs(words, wa.ALNUM[words.data])):
        inside = np.flatnonzero(rows[: len(crcs)] == rows[size : size + len(crcs)])
        out.append((inside, (crcs[inside] % _U4(buckets)).astype(np.int64)))
    return words.first, out


def bucket_counts(rows: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket.  The driver gets ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch, "t"):
                for _, found in _features(block.column(0), buckets)[1]:
                    seen += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in rows.select(F.col(text_col).alias("t")).mapInArrow(lean(count), "b int, n bigint").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    size, total, aim = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (total + size) / ((float(s) + 1) * (aim + size)))) for s, t in zip(source, target, strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "t"):
                first, runs = _features(block.column(1), buckets)
                by_word = np.zeros(first[-1] + 1, np.int64)
                for at, found in runs:
                    by_word[at] += shared.value[found]
                sums = np.concatenate([[0], np.cumsum(by_word)])
                n = np.diff(first)
                features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(x, pa.int64()) for x in (n, features, sums[first[1:]] - sums[first[:-1]]))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(lean(score), "id bigint, n_words bigint, n_features bigint, weight bigint")


#: What a run carries; the first four are its order: score from the highest, rows without id first, id, row number.
_RUN = ("score", "known", "id", "row", "n_features", "weight")


def _sorted_runs(splitters: list[np.ndarray], run_rows: int):
    """Sorted runs of each task's rows, cut where a splitter's order falls: (range, n, arrays)."""

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        cuts = len(splitters[0])
        both = [np.concatenate([s, c]) for s, c in zip(splitters, columns[:4], strict=True)]
        order = np.lexsort((np.arange(cuts + len(columns[0])) >= cuts, both[3], both[2], both[1], -both[0]))
        place = np.cumsum(order < cuts)[order >= cuts]
        rows = order[order >= cuts] - cuts
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        offsets = pa.array(np.append(starts, len(rows)), pa.int32())
        made = [pa.array(place[starts], pa.int32()), pa.array(np.diff(np.append(starts, len(rows))), pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(c[rows], pa.int64())) for c in columns)]
        return pa.RecordBatch.from_arrays(made, names=["range", "n", *_RUN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= run_rows:
                yield emit([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
        if held:
            yield emit([np.concatenate(c) for c in zip(*held, strict=True)])

    return lean(run)


def tournament(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, position) in the order of all runs together: a tree of winners, replayed from the leaf that gave the last one."""
    size = 1 << max(0, len(runs) - 1).bit_length()
    heads, last = [0] * len(runs), (math.inf,)
    keys = [r[0] if r else last for r in runs] + [last] * (size - len(runs))
    tree = [0] * size + list(range(size))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if keys[a] <= keys[b] else b
    while True:
        best = tree[1]
        if keys[best] is last:
            return
        yield best, heads[best]
        heads[best] += 1
        keys[best] = runs[best][heads[best]] if heads[best] < len(runs[best]) else last
        i = (size + best) // 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if keys[a] <= keys[b] else b
            i //= 2


def _merge(before: dict[int, int], drawn: int):
    """Ranks of a range's rows from its runs; rows past the draw have none and stay in no order."""

    def run(table: pa.Table) -> pa.Table:
        first = before[table.column("range")[0].as_py()]
        table = table.combine_chunks()
        columns = {c: table.column(c).combine_chunks() for c in _RUN}
        flat = {c: x.flatten().to_numpy() for c, x in columns.items()}
        ends = np.cumsum(table.column("n").to_numpy())
        keys = list(zip((-flat["score"]).tolist(), *(flat[c].tolist() for c in _RUN[1:4]), strict=True))
        starts = [0, *ends[:-1].tolist()]
        ranks = np.zeros(len(keys), np.int64)
        runs = [keys[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
        for rank, (r, i) in enumerate(tournament(runs), first + 1):
            if rank > drawn:
                break
            ranks[starts[r] + i] = rank
        made = [pa.array(flat["id"], mask=flat["known"] == 0), *(pa.array(flat[c]) for c in ("n_features", "weight", "score")), pa.array(ranks, mask=ranks == 0)]
        return pa.Table.from_arrays(made, names=["id", "n_features", "weight", "score", "rank"])

    return run


def draw(scored: DataFrame, percent: int, rows_per_range=200_000, run_rows=500_000) -> DataFrame:
    """(id, n_features, weight, score, rank): the ``percent`` percent (rounded down) highest of the rows that ``able`` marks get ranks 1, 2, 3...

    ``scored`` has id, n_features, weight, score, able.  The driver holds a sample of 16 rows for each ``rows_per_range`` (64 ranges
    at least), and the size of each range.
    """
    spark = scored.sparkSession
    rows = cut(scored.select("score", F.col("id").isNotNull().cast("long").alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("row"), "n_features", "weight", "able"))
    able = rows.where("able").select(*_RUN)
    count = able.count()
    drawn = count * percent // 100
    ranges = max(64, math.ceil(count / rows_per_range))
    share = min(1 << 30, math.ceil((1 << 30) * 16 * ranges / max(1, count)))
    sample = able.where(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)) < share).select(*_RUN[:4]).toArrow()
    keys = [sample.column(c).to_numpy() for c in _RUN[:4]]
    order = np.lexsort((keys[3], keys[2], keys[1], -keys[0]))[16::16]
    runs = cut(able.mapInArrow(_sorted_runs([k[order] for k in keys], run_rows), "range int, n bigint, " + ", ".join(f"{c} array<bigint>" for c in _RUN)))
    before, done, last = {}, 0, -1
    for r, n in runs.groupBy("range").agg(F.sum("n")).orderBy("range").collect():
        if done < drawn:
            before[r], last = done, r
        done += n
    whole_id = F.when(F.col("known") == 1, F.col("id")).alias("id")
    plain = [whole_id, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")]
    rest = runs.where(F.col("range") > last).select(F.inline(F.arrays_zip(*_RUN))).select(*plain)
    out = rest.unionAll(rows.where(~F.col("able")).select(*plain))
    if drawn:
        merged = runs.where(F.col("range") <= last).groupBy("range").applyInArrow(_merge(before, drawn), "id bigint, n_features bigint, weight bigint, score bigint, rank bigint")
        out = merged.unionAll(out)
    return out


def resample(docs: DataFrame, target: DataFrame, percent=5, min_words=20, buckets=10_000, seed=42, id_col="doc_id", text_col="text", target_text_col="text", **options) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null: not drawn)."""
    require(docs, id_col, text_col)
    require(target, target_text_col)
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(chance)))
    scored = weigh(docs, gains, id_col, text_col).select("id", "n_features", "weight", score.cast("long").alias("score"), (F.col("n_words") >= min_words).alias("able"))
    return draw(scored, percent, **options).withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH steps AS (  -- the register after one byte
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS step
  FROM range(256) AS r(b)),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (
  SELECT side, id, array_to_string(ws[i:i + k - 1], ' ') AS feature, count(*) AS n
  FROM (SELECT side, id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(ws) >= k) GROUP BY ALL),
named AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
bucket AS (
  SELECT feature, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
         lambda c, x: xor(step[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 10000 AS b FROM named, steps),
counted AS (SELECT side, id, b, sum(n) AS n FROM f JOIN bucket USING (feature) GROUP BY ALL),
g AS (
  SELECT CAST(b AS BIGINT) AS b, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM counted GROUP BY 1),
sums AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM g),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain FROM g, sums),
weights AS (SELECT id, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN gains USING (b) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(ws) AS n_words, CAST(len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN weights USING (id) WHERE side = 'd'),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM r) // 100 THEN r END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
