"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Items become windows of ``n`` consecutive words (an item with fewer words, but not none, is one window).  Documents
are tokenised in Arrow batches, all their windows are hashed and looked up in the sorted set of item windows, and
every hit is verified against the words themselves.  Documents never move: there is no shuffle.

The set is broadcast in blocks of at most ``block_bytes`` of item text.  One block is the usual case; with more, one
pass over the documents per block carries the hits along, so the broadcast is bounded whatever the benchmark's size.

Defined results: null or wordless texts have no words and no hits; null or wordless items have no windows; an empty
benchmark hits nothing; repeated items count once for each id; rows with the same document id are separate documents;
columns beyond those named are passed through ``clean`` untouched and may have any name but those starting ``_dc_``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import wordarrays as wa
from .common import cut, list_array, per_block, require


def _item_index(rows: list[Row], n: int) -> dict:
    """Windows of some items, by length: sorted hashes, their exact words and the ids of the items that have them."""
    by_size: dict[int, dict[bytes, tuple[int, set[int]]]] = {}
    words = wa.words_of(pa.array([r[1] for r in rows], pa.string()), wa.ALNUM)
    for i, row in enumerate(rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        size = min(n, b - a)
        if not size:
            continue
        hashes = wa.windows_hash(words.hashes[a:b], size)
        for k in range(b - a - size + 1):
            key = words.folded(a + k, a + k + size, wa.ALNUM)
            by_size.setdefault(size, {}).setdefault(key, (int(hashes[k]), set()))[1].add(int(row[0]))
    index = {}
    for size, windows in by_size.items():
        order = sorted(windows.items(), key=lambda x: x[1][0])
        hashes = np.array([h for _, (h, _) in order], dtype=np.uint64)
        index[size] = (hashes, [key for key, _ in order], [sorted(ids) for _, (_, ids) in order])
    return index


def _probe(words: wa.Words, index: dict) -> tuple[np.ndarray, list[set[int]]]:
    """(which words are hit, item ids of each row)."""
    n_rows = len(words.first) - 1
    edge = np.zeros(len(words.hashes) + 1, dtype=np.int32)
    items: list[set[int]] = [set() for _ in range(n_rows)]
    row_of = words.row_of()
    for size, (hashes, keys, ids) in index.items():
        found = wa.windows_hash(words.hashes, size)
        if not len(found):
            continue
        at = np.searchsorted(hashes, found)
        at[at == len(hashes)] = 0
        hits = np.flatnonzero(hashes[at] == found)
        hits = hits[row_of[hits] == row_of[hits + size - 1]]
        for i in hits:
            text = words.folded(i, i + size, wa.ALNUM)
            k = at[i]
            while k < len(hashes) and hashes[k] == found[i]:
                if keys[k] == text:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[row_of[i]].update(ids[k])
                    break
                k += 1
    return np.cumsum(edge[:-1]) > 0, items


def _spans(words: wa.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (start, end within its row) of runs of hit words, and n + 1 offsets by row."""
    row_of = words.row_of()
    at = np.flatnonzero(hit)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(words.first), np.int64)
    new = np.concatenate([[True], (np.diff(at) > 1) | (row_of[at[1:]] != row_of[at[:-1]])])
    a, b = at[new], np.concatenate([at[:-1][new[1:]], at[-1:]])
    rows = row_of[a]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(words.first) - 1))])
    return words.starts[a] - words.bounds[rows], words.ends[b] - words.bounds[rows], offsets


_SCHEMA = "_dc_words long, _dc_start array<long>, _dc_end array<long>, _dc_items array<long>"


def _annotate(df: DataFrame, index, text_col: str, first: bool, finish=None) -> DataFrame:
    """Adds, or with another block's index widens, the byte spans and items of each row.

    ``finish`` is a function of the resulting batch and the schema it leads to, so that one Python worker does both.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = wa.words_of(batch.column(batch.schema.get_field_index(text_col)), wa.ALNUM)
        hit, items = _probe(words, index.value)
        if not first:
            old_start, old_end, old_items = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_dc_start", "_dc_end", "_dc_items"))
            for i, (s, e) in enumerate(zip(old_start, old_end, strict=True)):
                items[i].update(old_items[i])
                a, b = words.first[i], words.first[i + 1]
                for x, y in zip(s, e, strict=True):
                    lo, hi = np.searchsorted(words.starts[a:b], (x + words.bounds[i], y + words.bounds[i]))
                    hit[a + lo : a + hi] = True
        start, end, offsets = _spans(words, hit)
        flat = [sorted(x) for x in items]
        made = {
            "_dc_words": pa.array(np.diff(words.first), pa.int64()),
            "_dc_start": list_array(pa.array(start, pa.int64()), offsets),
            "_dc_end": list_array(pa.array(end, pa.int64()), offsets),
            "_dc_items": pa.array(flat, pa.list_(pa.int64())),
            "_dc_hit": pa.array(np.add.reduceat(np.append(hit, False).astype(np.int64), words.first[:-1]) * (np.diff(words.first) > 0), pa.int64()),
        }
        names = [c for c in batch.schema.names if not c.startswith("_dc_")]
        out = pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *made.values()], names=[*names, *made])
        return finish[0](out) if finish else out

    kept = [f for f in df.schema.fields if not f.name.startswith("_dc_")]
    from pyspark.sql.types import LongType, StructType, _parse_datatype_string

    schema = finish[1] if finish else StructType(kept + _parse_datatype_string(_SCHEMA).fields).add("_dc_hit", LongType())
    return df.mapInArrow(per_block(run, text_col), schema)


def annotate(docs: DataFrame, bench: DataFrame, text_col="text", item_col="item_id", item_text_col="text", n=10, block_bytes=32 << 20, finish=None) -> DataFrame:
    """``docs`` with _dc_words, _dc_hit, _dc_items and the byte spans _dc_start, _dc_end of runs of hit words."""
    require(docs, text_col)
    require(bench, item_col, item_text_col)
    spark = docs.sparkSession
    items = bench.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(_item_index(part.collect(), n))
        docs = _annotate(docs, index, text_col, b == 0, finish if b == blocks - 1 else None)
        if b < blocks - 1:
            docs = cut(docs)
    return docs


def report(docs: DataFrame, bench: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    text_col = options.get("text_col", "text")
    found = annotate(docs.select(id_col, text_col), bench, **options)
    names = F.array_join(F.array_sort(F.transform("_dc_items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col(id_col),
        F.col("_dc_words").alias("n_words"),
        F.col("_dc_hit").alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.col("_dc_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, text_col="text", drop_share=0.5, **options) -> DataFrame:
    """Documents without their hit spans; those with at least ``drop_share`` of their words hit go.

    Other columns stay; n_chars, if it is there, is set anew where the text changed.  The cut text has one space in place of each span; untouched texts stay byte for byte.
    """
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, hit = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_dc_words", "_dc_hit"))
        batch = batch.filter(pa.array((hit == 0) | (hit < drop_share * words)))
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        texts, chars = get(text_col), get("n_chars") if "n_chars" in schema.names else None
        touched = np.flatnonzero(pc.list_value_length(get("_dc_start")).to_numpy(zero_copy_only=False) > 0)
        if len(touched):
            values = texts.to_pylist()
            for i in touched:
                raw, out, at = values[i].encode(), [], 0
                for s, e in zip(get("_dc_start")[i].as_py(), get("_dc_end")[i].as_py(), strict=True):
                    out.append(raw[at:s])
                    at = e
                values[i] = b" ".join([*out, raw[at:]]).decode("utf-8", "replace").strip()
            texts = pa.array(values, texts.type)
            if chars is not None:
                lengths = get("n_chars").to_pylist()
                for i in touched:
                    lengths[i] = len(values[i])
                chars = pa.array(lengths, chars.type)
        made = {text_col: texts, "n_chars": chars}
        return pa.RecordBatch.from_arrays([made.get(c) if made.get(c) is not None else get(c) for c in schema.names], names=schema.names)

    return annotate(docs, bench, text_col=text_col, finish=(run, schema), **options)


def no_items_digest() -> str:
    return hashlib.sha256(b"").hexdigest()


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
cand AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, cand.k, i, item_id FROM cand JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
