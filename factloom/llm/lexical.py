"""Ranked lexical search: MaxScore over the postings of each shard of documents.

Terms are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z.  A first pass over the texts keeps, of every
document, its number of terms and the postings of terms that some query has (found by hash, verified byte by byte).
Counts over all documents (how many have terms, all terms, documents of each query term) follow from these.  Then every
stored partition, in shards of at most ``shard_postings`` postings, is searched by itself.  A posting's part of the score
depends on term and document alone, so each list's largest part is known, an upper bound.  A query adds its lists to all
documents from the largest bound down, the essential lists; once the bounds of the rest together stay below the score of
the k-th document, the rest can't bring a new document in: they are only probed for documents that can still qualify,
fewer with every list.  The k-th score carries over to later shards of a task.  Shards give k rows for each query at most;
a window ranks them.  Texts never move.

Queries go in blocks of at most ``block_bytes`` of text, so what is broadcast (their terms) is bounded; there is one pass
over the documents for each block.

Scores are whole numbers: a term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), a document of n terms has
m = 75 + 25 n N div L, and its score sums w (10^9 tf div (1000 tf + 12 m)) over the query's terms, repeats included.

Defined results: null texts have no terms and are never found; queries without terms, or whose terms no document has,
have no rows; only scores above 0 count; equal scores rank by ascending id, null first; rows that repeat a document id are
documents of their own; rows that repeat a query id are queries of their own, each with its own ranks; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from . import wordarrays as wa
from .common import blocks, cut, lean, list_array, require


@dataclass
class Terms:
    """Distinct terms of some queries in order of their hash, and each query as (term, times) pairs."""

    hashes: np.ndarray
    words: list[bytes]
    lengths: np.ndarray
    queries: list[list[tuple[int, int]]]


def terms_of(texts: list[str | None]) -> Terms:
    words = wa.words_of(pa.array(texts, pa.string()), wa.ALNUM)
    spelled = [words.folded(i, i + 1, wa.ALNUM) for i in range(len(words.hashes))]
    known = sorted({(int(h), w) for h, w in zip(words.hashes, spelled, strict=True)})
    number = {w: i for i, (_, w) in enumerate(known)}
    queries = [sorted(Counter(number[w] for w in spelled[a:b]).items()) for a, b in zip(words.first, words.first[1:], strict=False)]
    return Terms(np.array([h for h, _ in known], np.uint64), [w for _, w in known], np.array([len(w) for _, w in known], np.int64), queries)


def _same_bytes(words: wa.Words, at: np.ndarray, number: np.ndarray, terms: Terms) -> np.ndarray:
    """Whether words ``at`` are spelled as terms ``number``."""
    length = words.ends[at] - words.starts[at]
    same = length == terms.lengths[number]
    for n in np.unique(length[same]):
        i = np.flatnonzero(same & (length == n))
        used, place = np.unique(number[i], return_inverse=True)
        table = np.frombuffer(b"".join(terms.words[u] for u in used), np.uint8).reshape(len(used), n)
        rows = max(1, (4 << 20) // int(n))
        for a in range(0, len(i), rows):
            part = i[a : a + rows]
            same[part] = (wa.ALNUM[words.data[words.starts[at[part]][:, None] + np.arange(n)]] == table[place[a : a + rows]]).all(axis=1)
    return same


def posting_lists(texts: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, n + 1 offsets of its postings, their term numbers, how often each occurs)."""
    words = wa.words_of(texts, wa.ALNUM)
    n_terms, n_rows = max(1, len(terms.hashes)), len(words.first) - 1
    if len(terms.hashes) and len(words.hashes):
        lo = np.searchsorted(terms.hashes, words.hashes)
        lo[lo == len(terms.hashes)] = 0
        at = np.flatnonzero(terms.hashes[lo] == words.hashes)
        number = lo[at]
        same = _same_bytes(words, at, number, terms)
        for i in np.flatnonzero(~same):  # another term with this hash, or none
            k = number[i]
            word = words.folded(at[i], at[i] + 1, wa.ALNUM)
            while k < len(terms.hashes) and terms.hashes[k] == words.hashes[at[i]]:
                if terms.words[k] == word:
                    number[i], same[i] = k, True
                    break
                k += 1
        rows = np.searchsorted(words.first, at[same], side="right") - 1
        keys, times = np.unique(rows * n_terms + number[same], return_counts=True)
    else:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(keys // n_terms, minlength=n_rows))])
    return np.diff(words.first), offsets, (keys % n_terms).astype(np.int32), times.astype(np.int64)


class Shard:
    """Postings of some documents by term, in the order of documents, with each posting's part of a score."""

    def __init__(self, norms: np.ndarray, offsets: np.ndarray, number: np.ndarray, times: np.ndarray, weights: np.ndarray):
        docs = np.repeat(np.arange(len(norms)), np.diff(offsets))
        parts = weights[number] * ((1_000_000_000 * times) // (1_000 * times + 12 * norms[docs]))
        order = np.argsort(number, kind="stable")
        self.docs, self.parts, self.n_docs = docs[order], parts[order], len(norms)
        self.first = np.searchsorted(number[order], np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.bound[some] = np.maximum.reduceat(self.parts, self.first[some])

    def search(self, query: list[tuple[int, int]], k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, k-th score): every document of the k best, and of those that equal the k-th, if its score is ``least`` or more."""
        lists = sorted(((self.bound[t] * q, t, q) for t, q in query if self.bound[t] > 0), reverse=True)
        rest = np.concatenate([np.cumsum([b for b, *_ in lists][::-1])[::-1], [0]]).astype(np.int64)
        scores, i = np.zeros(self.n_docs, np.int64), 0
        while i < len(lists) and rest[i] >= least:  # essential: a document in none of the lists before could still qualify
            _, t, q = lists[i]
            a, b = self.first[t], self.first[t + 1]
            scores[self.docs[a:b]] += q * self.parts[a:b]
            least, i = max(least, _kth(scores, k)), i + 1
        found = np.flatnonzero((scores > 0) & (scores + rest[i] >= least))
        scores = scores[found]
        while i < len(lists) and len(found):  # the others: only documents that can qualify are looked up
            _, t, q = lists[i]
            docs = self.docs[self.first[t] : self.first[t + 1]]
            at = np.searchsorted(docs, found)
            at[at == len(docs)] = 0
            scores += np.where(docs[at] == found, q * self.parts[self.first[t] + at], 0)
            least, i = max(least, _kth(scores, k)), i + 1
            can = scores + rest[i] >= least
            found, scores = found[can], scores[can]
        good = scores >= least
        return found[good], scores[good], least


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _searcher(terms: Terms, weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [1] * len(terms.queries)
        for batch in batches:
            ids, count, lists, often = batch.columns
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets, number, times = offsets - offsets[0], lists.flatten().to_numpy(), often.flatten().to_numpy()
            norms = 75 + (25 * count.to_numpy() * n_docs) // n_terms if n_terms else np.full(len(count), 75)
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + shard_postings, side="right")) - 1)
                a, b = offsets[at], offsets[stop]
                shard = Shard(norms[at:stop], offsets[at : stop + 1] - a, number[a:b], times[a:b], weights)
                rows: list[tuple[int, np.ndarray, np.ndarray]] = []
                for q, query in enumerate(terms.queries):
                    docs, scores, least[q] = shard.search(query, k, least[q])
                    if len(docs):
                        rows.append((q, docs + at, scores))
                if rows:
                    numbers = np.repeat([q for q, *_ in rows], [len(d) for _, d, _ in rows])
                    docs, scores = (np.concatenate([r[j] for r in rows]) for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), ids.take(pa.array(docs)), pa.array(scores, pa.int64())], names=["_q", "doc", "score"])
                at = stop

    return lean(run)


def _search_block(docs: DataFrame, items: list[Row], k: int, id_col: str, text_col: str, shard_postings: int) -> DataFrame:
    """(_q, doc, score) of at least the k best documents of each of some queries."""
    terms = terms_of([r["t"] for r in items])
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    shared = spark.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "t"):
                count, offsets, number, times = posting_lists(block.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count, pa.int64()), list_array(pa.array(number), offsets), list_array(pa.array(times), offsets)], names=["doc", "n", "terms", "times"])

    schema = StructType().add("doc", id_type).add("n", LongType()).add("terms", ArrayType(IntegerType())).add("times", ArrayType(LongType()))
    stored = cut(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).mapInArrow(lean(index), schema))
    n_docs, n_terms = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(terms.hashes), np.int64)
    for t, df in stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    found = StructType().add("_q", IntegerType()).add("doc", id_type).add("score", LongType())
    return stored.where(F.size("terms") > 0).mapInArrow(_searcher(terms, weights, n_docs, n_terms, k, shard_postings), found)


def search(docs: DataFrame, queries: DataFrame, k=20, id_col="doc_id", text_col="text", query_col="item_id", query_text_col="text", block_bytes=4 << 20, shard_postings=2_000_000) -> DataFrame:
    """(query_col, rank, id_col, score): the ``k`` best documents of each query, with scores above 0."""
    require(docs, id_col, text_col)
    require(queries, query_col, query_text_col)
    items = queries.select(F.col(query_col).alias("i"), F.col(query_text_col).alias("t")).where("t is not null")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    found = []
    for p in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p)
        rows = part.orderBy("i", "t").collect()
        names = docs.sparkSession.createDataFrame([(q, r["i"]) for q, r in enumerate(rows)], StructType().add("_q", IntegerType()).add(query_col, queries.schema[query_col].dataType))
        best = _search_block(docs, rows, k, id_col, text_col, shard_postings)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("doc").asc()))).where(F.col("rank") <= k)
        found.append(best.join(names, "_q").select(query_col, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"))
    return reduce(DataFrame.unionAll, found)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q)
  GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, nn),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS part FROM tf JOIN w USING (term), s),
x AS (SELECT item_id, doc_id, CAST(sum(part * times) AS BIGINT) AS score FROM p JOIN q USING (term) GROUP BY ALL HAVING sum(part * times) > 0)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM x) WHERE r <= 20
"""
