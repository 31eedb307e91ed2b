"""Line deduplication with a fixed-depth log-template tree.

The tree: a line goes by its number of tokens, then by its ``depth`` leading tokens, to a leaf.  Tokens with a digit count as
variable fields from the start.  In a leaf, lines merge by token similarity: two lines of n tokens are alike if they differ
in at most min(``fields``, n * (1 - ``similarity``)) places.  The places after the leading tokens are cut into one segment more
than that, so alike lines share a segment; of all lines of a leaf that share one, that in most documents (then that first seen
by document id and line number) is its template's seed, and the lines alike to the seed share its template, in which the places
where they differ are variable fields.  A line may so have several templates, and each line is one itself.

A template recurs if it occurs in at least ``most_docs`` documents, one of more than ``long_tokens`` tokens without a digit in two:
passages of that length don't repeat by chance.  Its lines are dropped from every document but the one with the smallest id, so
boilerplate goes while its content stays once.  Lines of fewer than ``least_tokens`` tokens without a digit have no template and always stay, so tables of
numbers do.

Lines are counted by hash with partial sums; only those that share a segment or recur, by a bitmap, move for the decision, and
each document moves once.  No pairs but those of a line and a seed are made, and joins have one side with a row a key.

Defined results: null texts stay null, texts without newline are one line; documents of which no word is left go, those that
had none to begin with stay; rows with a null id stay whole and aren't counted; rows equal in id and text count as one document,
other rows that repeat an id each, but keep each other's lines if their id is the smallest; an empty table gives no rows;
other columns, clashing names included, pass through ``clean``, n_chars (if it is there) is set anew where the text changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import blocks, cut, lean, per_block, require

_U = np.uint64
_powers = np.ones(1, dtype=_U)


def _line_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 1 << 12), 0x9FB21C651E98DF25, dtype=_U)
        step[0] = 1
        _powers = np.cumprod(step)
    return _powers


def places_to_differ(n: int | np.ndarray, similarity: float, fields: int):
    """In how many places a line of n tokens may differ from its seed."""
    return np.minimum(fields, np.floor(np.asarray(n) * (1 - similarity) + 1e-9)).astype(np.int64)


def tree_lines(column: pa.Array, depth: int, similarity: float, fields: int, least_tokens: int) -> dict[str, np.ndarray]:
    """Every line with enough tokens: row, line number, key, tokens n, those without a digit, segment keys [lines, fields + 1] (0: none), token hashes and the first of each."""
    words = wa.words_of(column, wa.SPACED)
    data, bounds = words.data, words.bounds
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    numeric = digits[words.ends] > digits[words.starts]
    hashes = np.where(numeric, _U(0xA5A5A5A5), words.hashes)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    row = words.row_of()
    line = newlines[words.starts] - newlines[bounds[row]]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(row)))
    if not len(begin):
        return {"row": row, "line": line, "key": np.zeros(0, np.int64), "n": size, "fixed": size, "segments": np.zeros((0, fields + 1), np.int64), "hashes": hashes, "begin": begin}
    fixed = np.add.reduceat((~numeric).astype(np.int64), begin)
    keep = fixed >= least_tokens
    place = np.arange(len(row)) - np.repeat(begin, size)
    weighted = hashes * _line_powers(int(size.max()))[place]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(weighted)])
    part = lambda lo, hi: sums[begin + hi] - sums[begin + lo]
    count = size.astype(_U) * _U(0xD6E8FEB86659FD93)
    key = wa.mix(part(np.zeros_like(size), size) + count)
    lead = np.minimum(depth, size)
    leaf = wa.mix(part(np.zeros_like(size), lead) + count)
    differ = places_to_differ(size, similarity, fields)
    rest = size - lead
    segments = np.zeros((len(begin), fields + 1), dtype=_U)
    for j in range(fields + 1):
        lo, hi = lead + rest * j // (differ + 1), lead + rest * (j + 1) // (differ + 1)
        some = (differ > 0) & (j <= differ) & (hi > lo)
        made = wa.mix(wa.mix(leaf + _U(j + 1)) ^ part(np.minimum(lo, size), np.minimum(hi, size)))
        segments[some, j] = made[some]
    at = begin[keep]
    return {"row": row[at], "line": line[at], "key": key[keep].view(np.int64), "n": size[keep], "fixed": fixed[keep], "segments": segments[keep].view(np.int64), "hashes": hashes, "begin": at}


def _bitmap(keys: DataFrame, most_bits: int) -> np.ndarray | None:
    """Two bits a key in a table of 64 bits a key; None where that is over ``most_bits``."""
    count = keys.count()
    bits = 1 << max(10, (64 * count).bit_length())
    if bits > most_bits:
        return None
    spots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1)))).alias("b"))
    words = spots.select(F.shiftright("b", 6).alias("w"), F.col("b").bitwiseAND(F.lit(63)).cast("int").alias("k")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("m")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out


def _count_lines(rows: DataFrame, depth: int, similarity: float, fields: int, least_tokens: int) -> DataFrame:
    """(key, docs, first, line, n, fixed, segments): each distinct line, in how many rows it occurs, and where first."""
    names = [f"s{j}" for j in range(fields + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            keys, ids, line, doc, n, fixed, segments = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((line, doc, ids, keys))
            keys, doc = keys[order], doc[order]
            start = np.flatnonzero(np.append([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            new = np.ones(len(keys), np.int64)
            new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            at = order[start]
            docs = np.add.reduceat(new, start) if len(keys) else new
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[start], docs, ids[at], line[at], n[at], fixed[at], *segments[at].T)], names=["key", "docs", "first", "line", "n", "fixed", *names])

        seen = 0
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            t = tree_lines(batch.column(2), depth, similarity, fields, least_tokens)
            held.append((t["key"], batch.column(1).to_numpy(zero_copy_only=False)[t["row"]], t["line"], t["row"] + seen, t["n"], t["fixed"], t["segments"]))
            seen += batch.num_rows
            size += len(t["key"])
            if size > 500_000:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()

    found = rows.mapInArrow(lean(run), f"key long, docs long, first long, line long, n long, fixed long, {', '.join(f'{s} long' for s in names)}")
    lines = found.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"), F.min_by("line", "first").alias("line"), *(F.first(c).alias(c) for c in ("n", "fixed", *names)))
    return lines.select("key", "docs", "first", "line", "n", "fixed", F.filter(F.array(*names), lambda s: s != 0).alias("segments"))


def _hits(keys: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(keys), bool)
    mask = len(bitmap) * 64 - 1
    keep = np.ones(len(keys), bool)
    for b in (keys & mask, (keys.view(_U) >> _U(32)).astype(np.int64) & mask):
        keep &= (bitmap[b >> 6] >> (b & 63)) & 1 == 1
    return keep


def templates(docs: DataFrame, id_col="doc_id", text_col="text", depth=2, similarity=0.8, fields=3, least_tokens=3, most_docs=5, long_tokens=50, most_bits=1 << 28) -> DataFrame:
    """(uid, id, line, docs, first): each line of a recurring template, by template.  uid is a hash of id and text."""
    options = depth, similarity, fields, least_tokens
    rows = docs.select(_uid(id_col, text_col).alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    lines = cut(_count_lines(rows, *options))
    enough = F.when(F.col("fixed") > long_tokens, 2).otherwise(most_docs)
    single = lines.where(F.col("docs") >= enough).select("key", F.col("key").alias("template"), F.lit(False).alias("merged"), enough.alias("least"))

    parts = lines.select("key", "docs", "first", "line", "n", "fixed", F.explode("segments").alias("segment"))
    shared = cut(parts.groupBy("segment").agg(F.count(F.lit(1)).alias("c"), F.sum("docs").alias("d"), F.max("fixed").alias("fixed")).where((F.col("c") > 1) & (F.col("d") >= enough)).select("segment"))
    members = cut(parts.join(shared, "segment"))
    rank = F.struct("docs", F.bitwise_not("first"), F.bitwise_not("line"), "key")
    seeds = cut(members.groupBy("segment").agg(F.max_by("key", rank).alias("seed"), F.max_by("fixed", rank).alias("fixed")))
    pairs = cut(members.drop("fixed").join(seeds, "segment").where("key <> seed").select("key", "seed", "n", "fixed").distinct())

    ends = pairs.select(F.explode(F.array("key", "seed")).alias("key")).distinct()
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast((_bitmap(ends.union(single.select("key")), most_bits), _bitmap(ends, most_bits)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in (part for whole in batches for part in blocks(whole, "text")):
            t = tree_lines(batch.column(2), *options)
            at = np.flatnonzero(_hits(t["key"], tables.value[0]))
            tokens: list[bytes | None] = [None] * len(at)
            for i in np.flatnonzero(_hits(t["key"][at], tables.value[1])):  # the tokens of a line once, or once a million lines
                k = int(t["key"][at[i]])
                if k not in told:
                    told.add(k)
                    begin = t["begin"][at[i]]
                    tokens[i] = t["hashes"][begin : begin + t["n"][at[i]]].tobytes()
            if len(told) > 1_000_000:
                told.clear()
            row = pa.array(t["row"][at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(t["line"][at], pa.int32()), pa.array(t["key"][at]), pa.array(tokens, pa.binary())], names=["uid", "id", "line", "key", "tokens"])

    found = cut(rows.mapInArrow(lean(places), "uid long, id long, line int, key long, tokens binary"))

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = (batch.column(i).to_pylist() for i in (2, 4, 5))
        keep = [int((np.frombuffer(x, _U) != np.frombuffer(y, _U)).sum()) <= places_to_differ(k, similarity, fields) for k, x, y in zip(n, a, b, strict=True)]
        return batch.select([0, 1, 3]).filter(pa.array(keep, pa.bool_()))

    tokens = cut(found.where("tokens is not null").groupBy("key").agg(F.first("tokens").alias("tokens")))
    both = pairs.join(tokens.withColumnRenamed("tokens", "a"), "key").join(tokens.select(F.col("key").alias("seed"), F.col("tokens").alias("b")), "seed")
    merged = cut(both.select("key", "seed", "n", "fixed", "a", "b").mapInArrow(per_block(alike, "a"), "key long, seed long, fixed long"))
    merged = merged.union(merged.select("seed", "seed", "fixed").distinct()).select("key", F.col("seed").alias("template"), F.lit(True).alias("merged"), enough.alias("least"))

    placed = cut(found.select("uid", "id", "line", "key").join(cut(single.union(merged)), "key").drop("key"))
    docs_of = placed.select("template", "merged", "least", "uid", "id").distinct().groupBy("template", "merged").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"), F.first("least").alias("least"))
    again = cut(docs_of.where("docs >= least").drop("least"))
    return placed.drop("least").join(again, ["template", "merged"]).select("uid", "id", "line", "docs", "first")


def drops(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """(uid, lines): for each text that loses some, the numbers of its lines that go.  uid is a hash of id and text."""
    return templates(docs, id_col, text_col, **options).where("id <> first").groupBy("uid").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _uid(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """(doc, gone, lines, kept): each row as a struct, the numbers of the lines that go (null: none), all lines, and those that stay."""
    require(docs, id_col, text_col)
    gone = drops(docs, id_col, text_col, **options)
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), _uid(id_col, text_col).alias("uid")).join(gone.select("uid", F.col("lines").alias("gone")), "uid", "left")
    out = out.withColumn("lines", F.split(F.col("doc").getField(text_col), "\n", -1))
    kept = F.filter("lines", lambda _, i: ~F.array_contains("gone", i))
    return out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept))


def report(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, text_sha256 of what stays."""
    rows = _with_drops(docs.select(id_col, text_col), id_col, text_col, options)
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    kept = F.when(F.col("lines").isNull(), 0).otherwise(F.size("kept"))
    sha = F.sha2(F.encode(F.coalesce(F.array_join("kept", "\n"), F.lit("")), "utf-8"), 256)
    return rows.select(F.col("doc").getField(id_col).alias(id_col), n.cast("long").alias("n_lines"), (n - kept).cast("long").alias("n_dropped"), sha.alias("text_sha256"))


def clean(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Documents without the dropped lines; all columns stay."""
    rows = _with_drops(docs, id_col, text_col, options)
    changed, old = F.col("gone").isNotNull(), F.col("doc")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(old.getField(text_col))
    rows = rows.withColumn("text", text).where(~changed | F.col("text").rlike("[^ \\t-\\r]"))
    values = {c: old.getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(old.getField("n_chars"))
    return rows.select(*(v.alias(c) for c, v in values.items()))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, i, line, list_transform(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
      lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ws FROM l),
o AS (SELECT * FROM (SELECT doc_id, i, ws, len(ws) AS n, CAST(least(3, len(ws) // 5) AS INT) AS differ, len(list_filter(ws, lambda w: w <> '<*>')) AS fixed FROM t) WHERE fixed >= 3),
d AS (SELECT ws, any_value(n) AS n, any_value(differ) AS differ, CASE WHEN any_value(fixed) > 50 THEN 2 ELSE 5 END AS least, count(DISTINCT doc_id) AS docs, min(doc_id) AS first, min_by(i, doc_id * 100000000 + i) AS place FROM o GROUP BY ws),
p AS (SELECT ws, n, least, docs, first, place, differ, j, ws[:2] AS lead, ws[2 + (n - 2) * j // (differ + 1) + 1 : 2 + (n - 2) * (j + 1) // (differ + 1)] AS part
      FROM (SELECT *, unnest(generate_series(0, differ)) AS j FROM d WHERE differ > 0)),
q AS (SELECT *, first_value(ws) OVER w AS seed, first_value(least) OVER w AS seed_least FROM p WINDOW w AS (PARTITION BY n, lead, j, part ORDER BY docs DESC, first, place)),
a AS (SELECT DISTINCT ws, seed, seed_least AS least FROM q WHERE ws <> seed AND len(list_filter(generate_series(1, n), lambda x: ws[x] <> seed[x])) <= differ),
m AS (SELECT ws, seed AS template, true AS merged, least FROM a UNION SELECT seed, seed, true, least FROM a UNION ALL SELECT ws, ws, false, least FROM d),
s AS (SELECT template, merged, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM o JOIN m USING (ws) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= any_value(m.least)),
g AS (SELECT DISTINCT doc_id, i FROM o JOIN m USING (ws) JOIN s USING (template, merged) WHERE doc_id <> first)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) - coalesce(m, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN g USING (doc_id, i) GROUP BY 1) USING (doc_id)
"""
