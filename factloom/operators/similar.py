"""Similarity join of short strings by their segments.

Two strings of lengths m >= n whose ratio 2 LCS / (m + n) reaches r differ by at most t = (1 - r)(m + n) inserted and deleted
characters.  Cut the longer one in T + 1 segments, T being the largest t that any partner allows: at least one segment
stays whole, and lies in the shorter one at most (t + m - n) / 2 places to the left and (t - m + n) / 2 to the right of its
own.  So segments are joined with equal pieces of shorter strings, in place of strings with strings; nothing is lost,
and what is found is then compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _budget(lengths: Column, least: float) -> Column:
    """How many characters two strings of this total length may differ by."""
    return F.floor(F.lit(1 - least) * lengths + 1e-9).cast("int")


def _number() -> Column:
    return F.xxhash64("scope", "s")


def _segments(rows: DataFrame, least: float) -> DataFrame:
    """(key, long, m, at) of each segment of each string as the longer one."""
    m = F.char_length("s")
    rows = rows.select("scope", _number().alias("long"), F.col("s").alias("ls"), m.alias("m"), (_budget(2 * m, least) + 1).alias("_n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    at, end = F.expr("cast(_i * m div _n as int)"), F.expr("cast((_i + 1) * m div _n as int)")
    return rows.select(F.xxhash64("scope", F.substring("ls", at + 1, end - at)).alias("key"), "long", "m", at.alias("at"))


def _pieces(rows: DataFrame, least: float) -> DataFrame:
    """(key, short, n, piece_at): all pieces that have the length of a segment of some longer partner."""
    n = F.char_length("s")
    rows = rows.select("scope", _number().alias("short"), F.col("s").alias("ss"), n.alias("n"))
    partners = F.sequence(F.col("n"), F.floor(F.col("n") * ((2 - least) / least) + 1e-9).cast("int"))

    def sizes(m: Column) -> Column:
        parts = _budget(2 * m, least) + 1
        return F.array(F.floor(m / parts).cast("int"), F.ceil(m / parts).cast("int"))

    rows = rows.select("*", F.explode(F.array_distinct(F.flatten(F.transform(partners, sizes)))).alias("_size")).where("_size <= n")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("_size"))).alias("piece_at"))
    return rows.select(F.xxhash64("scope", F.substring("ss", F.col("piece_at") + 1, F.col("_size"))).alias("key"), "short", "n", "piece_at")


def _matched(longer: DataFrame, shorter: DataFrame, least: float, more: Column) -> DataFrame:
    spare = _budget(F.col("m") + F.col("n"), least)
    shift = 2 * (F.col("piece_at") - F.col("at"))
    near = (shift >= -(spare + F.col("m") - F.col("n"))) & (shift <= spare - F.col("m") + F.col("n"))
    fits = (F.col("n") <= F.col("m")) & (2.0 * F.col("n") >= least * (F.col("m") + F.col("n")) - 1e-9)
    # a string makes dozens of pieces, so these are numbers, and of a string once in its scope; texts and ids come to the pairs that are found.
    # sizes of tables say nothing of how many pieces they make, so neither side may be broadcast
    strings = lambda rows: rows.select("scope", "s").distinct()
    found = _segments(strings(longer), least).hint("merge").join(_pieces(strings(shorter), least), "key").where(fits & near).select("long", "short")
    found = found.repartition("long").distinct()
    one = longer.select(_number().alias("_l"), F.col("scope"), F.col("id").alias("long"), F.col("s").alias("ls"), F.char_length("s").alias("m"))
    two = shorter.select(_number().alias("_s"), F.col("scope").alias("_scope"), F.col("id").alias("short"), F.col("s").alias("ss"), F.char_length("s").alias("n"))
    pairs = found.toDF("_l", "_s").hint("merge").join(one, "_l").hint("merge").join(two, "_s")
    return pairs.where((F.col("scope") == F.col("_scope")) & fits & more).select("scope", "long", "ls", "short", "ss")  # equal numbers of different strings add pairs at most


def _checked(least: float) -> None:
    if not 0.75 <= least <= 1:  # below, segments of one character aren't enough
        raise ValueError("the ratio must be from 0.75 to 1")


def candidates(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """(scope, a, b, sa, sb): all pairs of a left and a right string of a scope that can reach the ratio, each once.

    Both sides have (scope, id, s); a row is one string, and ids may have several.  Empty strings are in no pair.
    """
    _checked(least)
    left, right = (x.where("s <> ''").select("scope", "id", "s") for x in (left, right))
    one = _matched(left, right, least, F.col("n") <= F.col("m")).toDF("scope", "a", "sa", "b", "sb")
    two = _matched(right, left, least, F.col("n") < F.col("m")).toDF("scope", "b", "sb", "a", "sa")
    return one.unionByName(two).distinct().select("scope", "a", "b", "sa", "sb")


def self_candidates(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(scope, a, b, sa, sb) with a < b: all pairs of strings of different ids of a scope that can reach the ratio, each once."""
    _checked(least)
    rows = rows.where("s <> ''").select("scope", "id", "s")
    found = _matched(rows, rows, least, (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("long") < F.col("short")))).where("long <> short")
    swap = F.col("long") > F.col("short")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select("scope", either("long", "short").alias("a"), either("short", "long").alias("b"), either("ls", "ss").alias("sa"), either("ss", "ls").alias("sb")).distinct()
