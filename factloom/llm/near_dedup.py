"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Signatures: every text becomes its set of distinct word shingles (64-bit hashes), ``bands * rows`` minhashes, band
   keys and a sketch of one bit per minhash.  Equal sets collapse to one representative before anything is compared.
2. Banded candidates: in every bucket each member is compared with the bucket's smallest document, so a bucket of n
   members makes n - 1 pairs.  Signatures are compared in batches; after each batch a pair is dropped once the
   posterior probability that its similarity reaches the threshold is below ``miss``.
3. Survivors are verified on their full sets, the likeliest partner of each document first; what is in one component
   by then needs no more links.  In buckets that still hold several components, the pairs across components go
   through the same test, those of large buckets by way of their rarest shingles.  No link between components is lost.
4. Components: bounded tasks reduce their links to forests; more than one are contracted round by round,
   with a checkpoint each.

Joins of bucket members have one row a key on the other side, stored first, so that a large bucket's members can be dealt to
several tasks.

At the default 40 bands of 5 rows a pair at similarity 0.8 shares no bucket with probability 1.3e-7.

Defined results: texts without words (null, empty) have 0 shingles and stay alone; a text with fewer words than a
shingle has one shingle, its whole sequence; equal texts are one vertex, named by their smallest id, and so one component; an empty
table gives no rows.  Rows that repeat a document id are placed by their own texts each, in ``components`` too (but texts
that are both named by that id are one component there); ``keep`` tells rows of other texts apart and leaves one of
equal ones, but all without words.  Other columns, clashing names included, are ignored by ``components`` and passed through by
``keep``; a null id comes last.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import wordarrays as wa
from .common import cut, lean, list_array, per_batch, per_block, require

BANDS, ROWS, SKETCH = 40, 5, 128
_U = np.uint64


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1 << 20, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = wa.row_windows(wa.words_of(column, wa.SPACED), size)
    return [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """[texts, n] minima; texts without shingles have the largest value everywhere."""
    out = np.full((len(sets), n), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    a, b = _coefficients(n)
    at = 0
    while at < len(full):  # blocks that stay in cache
        stop, total = at, 0
        while stop < len(full) and (stop == at or total + len(sets[full[stop]]) <= 1 << 15):
            total += len(sets[full[stop]])
            stop += 1
        block = full[at:stop]
        x = (np.concatenate([sets[i] for i in block]) >> _U(32)).astype(np.uint32)
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in block])[:-1]])
        got = np.empty((n, len(block)), dtype=np.uint32)
        h = np.empty_like(x)
        for j in range(n):
            np.multiply(x, a[j], out=h)
            np.add(h, b[j], out=h)
            np.minimum.reduceat(h, begin, out=got[j])
        out[block] = got.T
        at = stop
    return out


def _signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    n = BANDS * ROWS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        mh = minhashes(sets, n)
        keys = np.empty((len(sets), BANDS), dtype=_U)
        for band in range(BANDS):
            h = np.full(len(sets), band + 1, dtype=_U)
            for j in range(ROWS):
                h = wa.mix(h * _U(0x9FB21C651E98DF25) + mh[:, band * ROWS + j].astype(_U))
            keys[:, band] = h
        bits = np.packbits((mh[:, :SKETCH] >> np.uint32(13)) & np.uint32(1), axis=1).view(np.int64)
        sig = (mh >> np.uint32(16)).astype(np.uint16)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sig], pa.binary()),
                list_array(pa.array(keys.ravel().view(np.int64)), np.arange(len(sets) + 1) * BANDS),
                pa.array(bits[:, 0] if len(sets) else np.zeros(0, np.int64)),
                pa.array(bits[:, 1] if len(sets) else np.zeros(0, np.int64)),
            ],
            names=["id", "n", "digest", "sig", "bands", "s0", "s1"],
        )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        per_block(run, "text"), "id long, n long, digest binary, sig binary, bands array<long>, s0 long, s1 long"
    )


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest matches of n with which P(similarity >= threshold | matches) is at least ``miss``, under a flat prior.

    That posterior is the lower tail of a binomial of n + 1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def _bayes(pairs: DataFrame, threshold: float, miss: float, batch_size: int = 40) -> DataFrame:
    """Of (a, b, sig_a, sig_b), the pairs that no batch rules out, with the share of matches: (a, b, est)."""
    n = BANDS * ROWS
    bounds = [(k, least_matches(k, threshold, miss)) for k in range(batch_size, n + 1, batch_size)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = batch.num_rows
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(size, n) for c in (2, 3))
        alive, matches = np.arange(size), np.zeros(size, dtype=np.int64)
        for k, least in bounds:
            matches[alive] += (left[alive, k - batch_size : k] == right[alive, k - batch_size : k]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        take = pa.array(alive)
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(matches[alive] / n)], names=["a", "b", "est"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(per_batch(run), "a long, b long, est double")


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            if len(x) and len(y):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(per_block(run, "ta", 2 << 20), "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, most_bits: int = 1 << 27) -> DataFrame:
    """(id, text) of at least the documents in ``ids``, and few others; an id may repeat.

    A bitmap of one hash, of 16 bits an id, is broadcast while it has at most ``most_bits``; beyond that texts are joined.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    count = ids.count()
    bits = 1 << max(10, (16 * count).bit_length())
    if bits > most_bits:
        return texts.join(ids, "id", "left_semi")
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("k")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("m")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(2).to_numpy()
        return batch.select([0, 1]).filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1))

    return texts.withColumn("bit", bit).mapInArrow(per_batch(run), "id long, text string")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, smallest vertex joined to it) by the edges of one partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "comp"])


def label_components(edges: DataFrame, edges_per_task: int = 2_000_000) -> DataFrame:
    """(id, comp) of every end of (a, b): comp is the smallest id reachable.

    Tasks of at most about ``edges_per_task`` edges each reduce theirs to a forest; where that is more than one task, the
    forests are contracted round by round.
    """
    edges = cut(edges.select("a", "b"))
    tasks = math.ceil(edges.count() / edges_per_task)
    forest = cut(edges.coalesce(max(1, tasks)).mapInArrow(lean(_forest), "id long, comp long"))
    if tasks <= 1:
        return forest
    labels = cut(forest.groupBy("id").agg(F.min("comp").alias("comp")))
    links = forest.select(F.col("id").alias("a"), F.col("comp").alias("b"))
    while True:  # hook every label to the smallest label next to it, follow that twice, and go on between labels
        at = lambda end: labels.select(F.col("id").alias(end), F.col("comp").alias(f"{end}2"))
        links = cut(links.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2").select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct())
        if not links.limit(1).count():
            break
        both = links.union(links.select("b", "a"))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        twice = hook.join(hook.select(F.col("a").alias("m"), F.col("m").alias("far")), "m").select("a", F.least("m", "far").alias("m"))
        labels = cut(labels.join(twice.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("m", "comp").alias("comp")))
    while True:  # labels may still point to vertices that have a smaller label themselves
        far = labels.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        step = cut(labels.join(far, "comp").select("id", F.col("far").alias("comp"), F.col("comp").alias("was")))
        labels = step.select("id", "comp")
        if not step.where("comp <> was").limit(1).count():
            return labels


def _across(docs, members, labels, small, id_col, text_col, shingle, percent, sketch_ok, few=16, rare=32) -> DataFrame:
    """Pairs (a, b) of one bucket but of different components, neither of them the bucket's hub, that may reach ``percent``.

    Buckets of at most ``few`` members are joined with themselves.  For the members of larger ones, shingles are counted
    among these members, and ordered by that count.  Two sets that reach the threshold share one of their first
    n - ceil(n * percent / 100) + 1 shingles.  Either that is one which at most ``rare`` members have: those are joined
    by shingle.  Or they share frequent shingles only, which bounds their intersection by the fewer of these: such pairs
    are joined by bucket under that bound.  Large groups of loosely related texts so make few pairs.
    """
    placed = members.where("members > 2").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def mixed(rows: DataFrame) -> DataFrame:
        keys = cut(rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"))
        return rows.join(keys, "key")

    placed = cut(mixed(placed).join(small, "rep").select("key", "rep", "comp", "n", F.col("n").alias("most"), "s0", "s1", "members"))
    owners = placed.where(F.col("members") > few).select("rep", "comp", "n", "s0", "s1").distinct()

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), shingle)
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))], names=["rep", "key"])

    ids = owners.select(F.col("rep").alias("id"))
    grams = cut(_texts_of(docs, ids, id_col, text_col).join(ids, "id", "left_semi").mapInArrow(per_block(explode, "text"), "rep long, key long"))
    counted = cut(grams.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep")).where(F.col("c") <= rare))
    own = counted.where("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    seldom = cut(grams.join(counted.where(F.col("c").between(2, rare)).select("key", "c"), "key"))
    owners = owners.join(own, "rep", "left").join(seldom.groupBy("rep").agg(F.count(F.lit(1)).alias("others")), "rep", "left")
    owners = owners.withColumn("own", F.coalesce("own", F.lit(0))).withColumn("others", F.coalesce("others", F.lit(0)))
    owners = cut(owners.withColumn("prefix", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))

    order = Window.partitionBy("rep").orderBy("c", "key")
    first = seldom.join(owners.where("own < prefix"), "rep").withColumn("rank", F.row_number().over(order)).where("rank + own <= prefix")
    common = owners.where("own + others <= prefix").select("rep", (F.col("n") - F.col("own") - F.col("others")).alias("most"))
    large = placed.where(F.col("members") > few).drop("most").join(common, "rep")
    large = cut(large)
    fewest = cut(large.groupBy("key").agg(F.min("n").alias("fewest")))
    enough = 100 * F.col("most") >= percent * (F.col("n") + F.greatest("fewest", "most") - F.col("most"))
    large = large.join(fewest, "key").where(enough)

    def joined(rows: DataFrame) -> DataFrame:
        x = rows.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("s0").alias("p0"), F.col("s1").alias("p1"))
        y = rows.select(F.col("key").alias("key2"), F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("s0").alias("q0"), F.col("s1").alias("q1"))
        inter = F.least("ma", "mb")
        may = (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * inter >= percent * (F.col("na") + F.col("nb") - inter)) & sketch_ok("p", "q")
        return x.join(y, (F.col("key") == F.col("key2")) & may).select("a", "b")

    columns = ["key", "rep", "comp", "n", "most", "s0", "s1"]
    by_gram = mixed(first.withColumn("most", F.col("n")).select(columns))
    return joined(placed.where(F.col("members") <= few).select(columns)).union(joined(by_gram)).union(joined(mixed(large.select(columns)))).distinct()


def components(docs: DataFrame, id_col="doc_id", text_col="text", shingle=5, percent=80, miss=1e-7) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    require(docs, id_col, text_col)
    threshold = percent / 100
    all_rows = cut(_signatures(docs, id_col, text_col, shingle))
    reps = all_rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sig", "bands", "s0", "s1")))
    reps = cut(reps)

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = cut(keyed.join(buckets, "key").where("rep <> hub"))

    size_ok = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    sketch_ok = lambda x, y: F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0"))) + F.bit_count(F.col(f"{x}1").bitwiseXOR(F.col(f"{y}1"))) <= _most_mismatches(threshold)
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sig_a"), F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sig_b"), F.col("s0").alias("q0"), F.col("s1").alias("q1"))
    stars = members.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    tested = cut(_bayes(stars.join(left, "a").join(right, "b").where(size_ok(F.col("na"), F.col("nb")) & sketch_ok("p", "q")), threshold, miss))
    best = tested.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    texts = cut(_texts_of(docs, tested.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col))
    links = cut(_verify(best, texts, shingle, percent))
    labels = label_components(links)

    comp_of = lambda df, end: df.join(labels.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    open_stars = cut(comp_of(comp_of(tested, "a"), "b").where("ca <> cb").select("a", "b"))
    links = cut(links.union(_verify(open_stars, texts, shingle, percent)))
    labels = label_components(links)

    cross = _across(docs, members, labels, reps.select("rep", "n", "s0", "s1"), id_col, text_col, shingle, percent, sketch_ok)
    late = cut(_bayes(cross.join(left, "a").join(right, "b"), threshold, miss).select("a", "b"))
    more = cut(_verify(late, _texts_of(docs, late.select(F.explode(F.array("a", "b")).alias("id")), id_col, text_col), shingle, percent))
    if more.limit(1).count():
        labels = label_components(links.union(more))

    by_digest = reps.select("digest", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    return all_rows.select("id", "n", "digest").join(by_digest, "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "id").alias("component_id"),
        (F.col("id") == F.coalesce("comp", "id")).alias("kept"),
    )


def _most_mismatches(threshold: float, miss: float = 1e-8) -> int:
    """Most differing sketch bits that a pair at the threshold has, but for a share of ``miss``."""
    p, total = (1 - threshold) / 2, 0.0
    for k in range(SKETCH, -1, -1):
        total += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if total > miss:
            return k
    return SKETCH


def keep(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of which each component keeps one: that with the smallest id, then a row tie-break.  All columns stay.

    Components are those of pairs of id and text, by hash, so ids may repeat with equal or other texts.
    """
    uid = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 1)
    rows = docs.select(uid.alias("uid"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    found = components(docs.select(uid.alias("uid"), text_col), "uid", text_col, **options).where("n_shingles > 0")
    found = cut(found.groupBy("uid").agg(F.first("component_id").alias("comp"), F.count(F.lit(1)).alias("times")))
    linked = found.join(found.where("uid <> comp").select("comp").distinct(), "comp").select("comp", "uid")
    with_id = linked.join(rows.select("uid", F.col("doc").getField(id_col).alias("id")), "uid")
    winner = with_id.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "uid"))["uid"].alias("best"))
    gone = cut(linked.join(winner, "comp").where("uid <> best").select("uid"))
    kept = rows.join(gone, "uid", "left_anti")
    repeated = cut(found.where("times > 1").select("uid"))
    if repeated.limit(1).count():
        one = kept.join(repeated, "uid", "left_semi").groupBy("uid").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        kept = kept.join(repeated, "uid", "left_anti").select("doc").union(one.select("doc"))
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(m.c, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
