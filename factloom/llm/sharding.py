"""Range sharding by sampled splitters, with DataFrame functions only.

Every row has a sortable key (a long) and a size.  Rows are drawn with a probability in proportion to their size (a
hash of key and id decides, so a retry draws the same rows); the drawn keys, in order, are splitters of fine ranges of
about equal size.  The size of each range is then counted exactly; a range over ``slack`` times the mean is subdivided by
a denser draw inside it.  In key order, a row's shard follows from the bytes before it: those of the earlier ranges, from
the counts, and a running sum in its own range.  So sizes differ by about one row, and no task ever sorts a whole shard.

Rows that share the key bits of ``group_mask`` are a group.  A group of at most ``small_group`` of a shard's share stays
in one shard; a larger one divides.  The query's key has 32 bits of the text's hash above 32 bits of the id's: its groups
are equal texts.

Defined results: a null text counts as empty (its size is the fixed part); an empty table gives no rows; rows that
repeat an id get slots of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, require


def longs(values) -> Column:
    """A constant array of longs, parsed once when the plan is optimised, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if len(values) else F.array().cast("array<bigint>")


def range_index(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most ``key``: two short linear searches, of the square root of their number each."""
    if not len(splitters):
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    block = F.size(F.filter(longs(splitters[::step]), lambda x: x <= key))
    inner = F.slice(longs(splitters), (F.greatest(block, F.lit(1)) - 1) * step + 1, F.lit(step))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + F.size(F.filter(inner, lambda x: x <= key))).cast("int")


def _draw(rows: DataFrame, rate: Column) -> list[int]:
    """Keys of rows drawn with probability ``rate`` times their size."""
    chance = F.pmod(F.xxhash64("key", "id", F.lit(77)), F.lit(1 << 40)) / float(1 << 40)
    return [r[0] for r in rows.where(chance < F.col("size") * rate).select("key").distinct().collect()]


def _histogram(rows: DataFrame, splitters: list[int]) -> list[Row]:
    """(range, size, number of rows) of each range that has rows."""
    return rows.groupBy(range_index(F.col("key"), splitters).alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("r").collect()


def shard(rows: DataFrame, n_shards: int, group_mask=-1, ranges_per_shard=24, rows_per_range=2_000_000, slack=2.0, small_group=0.02) -> DataFrame:
    """(id, key, size, ...) with ``shard`` and ``slot`` added; sizes of shards are near equal.

    The driver holds the splitters, about max(n_shards * ranges_per_shard, rows / rows_per_range) longs, and as many counts.
    """
    require(rows, "id", "key", "size")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not count:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(n_shards * ranges_per_shard, math.ceil(count / rows_per_range))
    drawn = sorted(_draw(rows, F.lit(8.0 * ranges / total)))
    splitters = sorted({k & group_mask for k in drawn[:: max(1, len(drawn) // ranges)]})
    found = _histogram(rows, splitters)
    over = [int(r["r"]) for r in found if r["size"] > slack * total / ranges]
    if over:
        inside = rows.where(range_index(F.col("key"), splitters).isin(over))
        splitters = sorted({*splitters, *_draw(inside, F.lit(2.0 * ranges / total))})
        found = _histogram(rows, splitters)
    before, done = {}, 0
    for r in found:
        before[r["r"]] = done
        done += r["size"]

    def pick(table: dict, at: Column) -> Column:
        return F.element_at(F.expr("array(" + ",".join(f"{table.get(i, 0)}L" for i in range(len(splitters) + 1)) + ")"), at + 1)

    in_range = Window.partitionBy("_range").orderBy("key", "id")
    by_group = Window.partitionBy("_range").orderBy("_group")
    placed = rows.withColumn("_range", range_index(F.col("key"), splitters)).withColumn("_group", F.col("key").bitwiseAND(F.lit(group_mask)))
    placed = placed.withColumn("_rank", F.row_number().over(in_range)).withColumn("_ends", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_group_ends", F.sum("size").over(by_group.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_group_size", F.sum("size").over(Window.partitionBy("_range", "_group")))
    middle = F.when(F.col("_group_size") <= small_group * total / n_shards, F.col("_group_ends") - F.col("_group_size") / 2).otherwise(F.col("_ends") - F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor((pick(before, F.col("_range")) + middle) * n_shards / total), F.lit(n_shards - 1)).cast("int"))
    placed = cut(placed.drop("_ends", "_group", "_group_ends", "_group_size"))

    counts = placed.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_rank").alias("lo")).orderBy("_range", "shard").collect()
    fill, shift = [0] * n_shards, {}
    for r in counts:
        shift.setdefault(r["_range"], []).append((r["shard"], fill[r["shard"]] - r["lo"]))
        fill[r["shard"]] += r["n"]
    first = {r: x[0][0] for r, x in shift.items()}
    moves = F.expr("array(" + ",".join("array(" + ",".join(f"{m}L" for _, m in _filled(shift.get(i, [(0, 0)]))) + ")" for i in range(len(splitters) + 1)) + ")")
    move = F.element_at(F.element_at(moves, F.col("_range") + 1), (F.col("shard") - pick(first, F.col("_range"))).cast("int") + 1)
    return placed.withColumn("slot", F.col("_rank") + move).drop("_range", "_rank")


def _filled(moves: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Consecutive shards, those without rows too."""
    known = dict(moves)
    return [(k, known.get(k, 0)) for k in range(moves[0][0], moves[-1][0] + 1)]


def digest_rows(docs: DataFrame, id_col="doc_id", text_col="text", overhead=16) -> DataFrame:
    """(id, size, crc, key) of each document, computed once."""
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32)))
    low = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(id_col)), 32)
    return cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("crc"),
            high.bitwiseOR(low).alias("key"),
        )
    )


def shard_documents(docs: DataFrame, n_shards=40, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: id, size, text_crc32, law (bytes), shard, slot, grown_shard (null under this law)."""
    done = shard(digest_rows(docs, id_col, text_col), n_shards, group_mask=-(1 << 32))
    return done.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
