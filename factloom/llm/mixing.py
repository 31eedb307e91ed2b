"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, with DataFrame functions only.

Every source has a weight; targets share all words by weight, but stop at ``max_repeats`` times what the source has, and
the excess goes to the others by weight.  The mix is cut in blocks of ``block`` words.  The blocks go to sources in the
order of the quotients target / (2k + 1), k the blocks that the source has already; ties go to the earlier source.  Shard
j takes the next share of that order, so it has an integer quota of blocks from every source, and any run of shards is as
close to the targets as blocks allow.  Only quotients near each shard's end are ever made: a divisor within half the
number of sources of the right one tells which are surely in.

Which blocks a source gives is seeded: a hash of seed and id orders its documents into one stream of words, and its
blocks are consecutive there, in that order, around again after the last word.  A document's place is a sum over earlier
buckets of hashes, and a running sum in its own bucket, so that no task orders a whole source.

Defined results: null texts have no words; null is a source of its own, after all others; an empty table gives no rows;
rows that repeat an id are documents of their own (those equal in id and words too take places side by side); null ids
count as equal ids; a source without words has target 0; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, require

WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def cyclic_weights(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """``sources`` (one row per source) with ``place`` in code point order, null last, and ``weight`` from the repeating cycle."""
    ordered = cut(sources.repartitionByRange(F.col("source").asc_nulls_last())).withColumn("_part", F.spark_partition_id())
    before, done = [], 0
    sizes = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}
    for p in range(max(sizes, default=-1) + 1):
        before.append(done)
        done += sizes.get(p, 0)
    skipped = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    in_part = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    place = F.element_at(skipped, F.col("_part") + 1) + F.row_number().over(in_part) - 1
    weights = F.array(*(F.lit(w).cast("bigint") for w in cycle))
    return ordered.withColumn("place", place).withColumn("weight", F.element_at(weights, (F.pmod("place", F.lit(len(cycle))) + 1).cast("int"))).drop("_part")


def level(sources: DataFrame, total: int, max_repeats: int) -> float:
    """Words for each unit of weight, so that least(max_repeats * source_size, weight * level) sums to ``total``.

    Newton's steps from below: each fixes the sources over their limit, and shares what is left by weight.
    """
    limit, now = F.col("source_size") * max_repeats, 0.0
    while True:
        over = limit < F.col("weight") * F.lit(now)
        fixed, free = sources.agg(F.coalesce(F.sum(F.when(over, limit)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        after = (total - fixed) / free if free else now
        if after <= now:
            return now
        now = after


def quotas(sources: DataFrame, houses: list[int]) -> DataFrame:
    """(key, seats array): blocks of each source among the first ``houses[j]`` of the order by quotients.

    The order is by target / (2k + 1) from the largest, ties by place.  ``sources`` has key, place, target; houses ascend.
    """
    some = sources.where("target > 0")
    count, total = some.agg(F.count(F.lit(1)), F.sum("target")).first()
    if not count:
        return sources.select("key", F.array_repeat(F.lit(0).cast("bigint"), len(houses)).alias("seats"))
    house = F.array(*(F.lit(h).cast("bigint") for h in houses))
    share = F.col("target") / F.lit(float(total))
    ends = some.select("key", "place", "target", F.posexplode(house).alias("j", "house"))
    seats_at = lambda divisor: F.floor(F.greatest(divisor, F.lit(0.0)) * share + 0.5)
    ends = ends.withColumn("sure", seats_at(F.col("house") - (count / 2 + 1))).withColumn("most", seats_at(F.col("house") + (count / 2 + 1)))
    ends = ends.withColumn("open", F.col("house") - F.sum("sure").over(Window.partitionBy("j")))
    undecided = ends.select("*", F.explode_outer(F.when(F.col("most") > F.col("sure"), F.sequence(F.col("sure"), F.col("most") - 1))).alias("k"))
    rank = F.row_number().over(Window.partitionBy("j").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc_nulls_last(), "place"))
    taken = undecided.withColumn("taken", F.col("k").isNotNull() & (rank <= F.col("open"))).groupBy("key", "j").agg((F.first("sure") + F.count_if("taken")).alias("n"))
    lists = taken.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "n"))), lambda x: x["n"]).alias("seats"))
    return sources.select("key").join(lists, "key", "left").select("key", F.coalesce("seats", F.array_repeat(F.lit(0).cast("bigint"), len(houses))).alias("seats"))


def mix(docs: DataFrame, weights: DataFrame | None = None, n_shards=16, max_repeats=3, seed=42, block: int | None = None, finest=512, largest_block=1 << 20, rows_per_bucket=20_000, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), parts.

    parts lists what the mix takes of the document: struct(shard, copy, start, words), start in words from its beginning.
    ``weights`` has source and weight (whole numbers; sources it lacks weigh 0), else the weights are 1, 2, 3, repeating, in code point order.
    ``block`` is the words of a block; if None, the smallest target has about ``finest`` of them, at most ``largest_block``
    words each.  The driver holds n_shards numbers and one number for each partition of the sources.
    """
    require(docs, id_col, text_col, source_col)
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.conv(F.substring(mark, 1, 13), 16, 10).cast("long").alias("h")))
    rows = rows.withColumn("key", _key(F.col("source")))

    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = cyclic_weights(sources)
    if weights is not None:
        given = weights.select(_key(F.col("source")).alias("key"), F.col("weight").cast("long").alias("_given")).groupBy("key").agg(F.max("_given").alias("_given"))
        sources = sources.join(given, "key", "left").withColumn("weight", F.coalesce("_given", F.lit(0))).drop("_given")
    sources = cut(sources)
    total, count = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = level(sources, total, max_repeats)
    sources = sources.withColumn("target", F.least((F.col("source_size") * max_repeats).cast("double"), F.col("weight") * F.lit(share)))
    if block is None:
        least = sources.where("target > 0").agg(F.min("target")).first()[0]
        block = max(1, min(largest_block, math.floor((least or 1) / finest)))
    whole = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    blocks = int(whole / block + 0.5)
    houses = [(2 * j * blocks + n_shards) // (2 * n_shards) for j in range(1, n_shards + 1)]
    limit = F.col("source_size") * max_repeats
    sources = sources.join(quotas(sources, houses), "key").withColumn("ends", F.transform("seats", lambda n: F.least(n * F.lit(block), limit)))

    buckets = max(256, math.ceil(count / rows_per_bucket))
    dealt = rows.withColumn("bucket", F.shiftright(F.shiftright("h", 20) * F.lit(buckets), 32)).withColumn("_part", F.spark_partition_id())
    dealt = dealt.groupBy("key", "source", "bucket", "h", "id", "size", "_part").agg(F.count(F.lit(1)).alias("copies"))  # equal rows count once in each partition
    words = F.col("size") * F.col("copies")
    sums = rows.withColumn("bucket", F.shiftright(F.shiftright("h", 20) * F.lit(buckets), 32)).groupBy("key", "bucket").agg(F.sum("size").alias("_sum"))
    places = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    places = places.drop("_sum").join(sources.select("key", "source_size", "target", "ends"), "key")
    here = Window.partitionBy("key", "bucket").orderBy("h", "id", "size", "_part").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_at", F.sum(words).over(here) - words).join(places, ["key", "bucket"])
    placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("_copy"))
    at = F.col("_before") + F.col("_at") + F.col("_copy") * F.col("size")

    def parts_of(copy: Column) -> Column:
        begin = copy * F.col("source_size") + at

        def part(end: Column, j: Column) -> Column:
            lo = F.greatest(F.when(j > 0, F.element_at("ends", j)).otherwise(F.lit(0)), begin)
            hi = F.least(end, begin + F.col("size"))
            return F.struct(j.cast("int").alias("shard"), copy.cast("int").alias("copy"), (lo - begin).alias("start"), (hi - lo).alias("words"))

        return F.transform("ends", part)

    parts = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), parts_of)), lambda x: x["words"] > 0)
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", parts.alias("parts"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes, repeats counted), shards (how many hold some of it)."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    taken = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    shards = F.size(F.array_distinct(F.transform("parts", lambda x: x["shard"])))
    return mix(docs, **options).select(id_col, source_col, "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % 3 + 1 AS weight, CAST((SELECT sum(ss) FROM s) AS BIGINT) AS total FROM s),
levels AS (
  SELECT *, (total - coalesce(sum(3 * ss) OVER before, 0)) / CAST(sum(weight) OVER onward AS DOUBLE) AS share FROM w
  WINDOW before AS (ORDER BY 3 * ss / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY 3 * ss / CAST(weight AS DOUBLE), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lev AS (SELECT max(share) AS share FROM levels),
t AS (SELECT w.*, least(CAST(3 * ss AS DOUBLE), weight * lev.share) AS target FROM w, lev),
b AS (SELECT greatest(1, least(1048576, CAST(floor(min(target) FILTER (WHERE target > 0) / 512) AS BIGINT))) AS block, sum(target) AS whole FROM t),
n AS (SELECT block, whole, CAST(floor(whole / block + 0.5) AS BIGINT) AS blocks FROM b),
q AS (
  SELECT place, target / (2 * k + 1) AS quotient FROM (
    SELECT place, target, unnest(generate_series(0, CAST(ceil(target / whole * blocks) AS BIGINT) + 40)) AS k FROM t, n WHERE target > 0)),
r AS (SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS r FROM q),
h AS (SELECT j, (2 * (j + 1) * blocks + 16) // 32 AS house FROM n, range(16) AS x(j)),
seats AS (SELECT place, j, count(*) FILTER (WHERE r <= house) AS seats FROM r, h GROUP BY place, j),
ends AS (
  SELECT source, ss, target, j, least(3 * ss, coalesce(seats, 0) * block) AS hi FROM n, t CROSS JOIN (SELECT j FROM h) LEFT JOIN seats USING (place, j)),
l AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY source ORDER BY j), 0) AS lo FROM ends),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS pos FROM d),
parts AS (
  SELECT doc_id, p.source, size, ss, target, j, greatest(0, least(hi, e * ss + pos + size) - greatest(lo, e * ss + pos)) AS words
  FROM p JOIN l ON p.source IS NOT DISTINCT FROM l.source, range(3) AS x(e))
SELECT doc_id, source, size, ss AS source_size, target, CAST(sum(words) AS BIGINT) AS taken, CAST(count(DISTINCT j) FILTER (WHERE words > 0) AS INT) AS shards
FROM parts GROUP BY doc_id, source, size, ss, target
"""
