"""Bottom-k sketches of word shingles, with DataFrame functions only.

A text's words are runs of anything but ASCII white space, lower-cased; its shingles are ``shingle`` consecutive words (a
text with fewer words has one, its whole sequence), hashed to 64 bits.  A sketch is the sorted array of the k smallest
distinct hashes.  Sketches of parts merge into that of the whole; two of them estimate resemblance and containment, one
estimates the number of distinct shingles.  All of it is exact while a set, or a union, has at most k shingles.

Defined results: a null text is empty; an empty sketch resembles another empty one fully and others not at all; rows that
repeat an id follow each other in order of their texts, null ids come last; the only row is its own successor; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import require
from .sharding import longs, range_index

BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k=128, shingle=5) -> Column:
    """Sorted array of the k smallest distinct shingle hashes of a text."""
    words = F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), "[ \\t-\\r]+")
    none = F.array().cast("array<bigint>")
    return _let(words, lambda w: F.when(F.element_at(w, 1) == "", none).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: sketch_of_words(h, k, shingle))))


def sketch_of_words(hashes: Column, k: int, shingle: int) -> Column:
    """The same from an array of word hashes that isn't empty."""
    n = F.size(hashes)
    every = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(shingle))))
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= shingle, every).otherwise(F.array(F.xxhash64(hashes))))), 1, k)


def merge(a: Column, b: Column, k=128) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k=128) -> Column:
    """Estimated intersection over union."""
    share = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return _let(merge(a, b, k), share)


def distinct_shingles(a: Column, k=128) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k=128) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string of 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_successor(rows: DataFrame, id_col: str, tie_col: str, fields: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, range_bytes=4 << 20) -> DataFrame:
    """Each row with ``next``: the struct of ``fields`` of the row after it in descending id order; the last has the first.

    Rows are dealt to ranges of ids, of about ``range_bytes`` of ``tie_col`` each (or a millionth of all, if that is more), at
    sampled splitters; a copy of each range's first row joins the range before it, so that no range needs another.  The driver
    holds eight sampled ids for each range.
    ``derive`` adds columns after the rows have been dealt, so that these needn't move.
    """
    count, total, low, high = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(tie_col)), F.min(id_col), F.max(id_col)).first()
    if not count:
        derived = derive(rows)
        return derived.withColumn("next", F.struct(*fields))
    ranges = math.ceil(max(1, total or 0) / max(range_bytes, (total or 0) >> 20))
    drawn = rows.select(id_col)
    if count > 8 * ranges:
        drawn = drawn.where(F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * 8 * ranges / count))
    keys = np.unique(drawn.toArrow().column(0).drop_null().to_numpy())
    splitters = np.setdiff1d(keys[:: max(1, len(keys) // ranges)], [low]).tolist() if ranges > 1 else []
    at = range_index(F.col(id_col), splitters)
    heads = {r["r"]: r["head"] for r in rows.groupBy(at.alias("r")).agg(F.max(id_col).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}
    if len(before) <= 1:
        ghost = F.when(F.col(id_col).eqNullSafe(F.lit(high)), F.lit(order[0]))
    else:
        ordered = sorted(before)
        place = F.greatest(range_index(F.col(id_col), ordered), F.lit(1))
        ghost = F.when(F.element_at(longs(ordered), place) == F.col(id_col), F.element_at(longs([before[x] for x in ordered]), place).cast("int"))
    copies = F.when(ghost.isNull(), F.array(F.struct(at.alias("r"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(at.alias("r"), F.lit(False).alias("ghost")), F.struct(ghost.alias("r"), F.lit(True).alias("ghost")))
    )
    dealt = rows.withColumn("_c", F.explode(copies)).select(*rows.columns, F.col("_c.r").alias("_r"), F.col("_c.ghost").alias("_ghost")).repartitionByRange("_r")
    # the copy that closes the last range comes from the largest ids and must sort after the rest
    window = Window.partitionBy("_r").orderBy(F.asc("_ghost"), F.desc(id_col), F.asc(tie_col))
    return derive(dealt).withColumn("next", F.lead(F.struct(*fields)).over(window)).where("not _ghost").drop("_r", "_ghost")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", k=128, shingle=5) -> DataFrame:
    """One row per document with its sketch, that of its edited text, and how alike they and the next document's are."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_successor(rows, "id", "text", ["text", "sketch"], lambda df: df.withColumn("sketch", sketch(F.col("text"), k, shingle)))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - floor(char_length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    made = paired.select("id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    made = made.select("id", "n_chars", "sketch", "next_sketch", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, shingle).alias("edited_sketch"))
    return made.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("est_shingles"),
    )
