"""Chunking, token and span operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sentences(text: Column) -> Column:
    """Split after sentence marks that white space follows."""
    return F.split(text, "(?U)(?<=[.!?])\\s+")


def pack_sentences(text: str, most: int = 2000, overlap: int = 200, keep_empty: bool = False) -> list[str]:
    """Sentences packed while the chunk stays under ``most``; the next chunk starts with the tail of the last one.

    The tail is its last ``overlap`` characters without their first sentence fragment.  A first sentence that is too long
    would leave an empty chunk before it; ``keep_empty`` keeps that one.
    """
    out, current = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if len(current) + len(sentence) < most:
            current += sentence + " "
            continue
        if current.strip() or keep_empty:
            out.append(current.strip())
        tail = current[-overlap:] if overlap else ""
        parts = re.split(r"(?<=[.!?])\s+", tail, maxsplit=1)
        current = f"{parts[1] if len(parts) > 1 else ''} {sentence} "
    if current.strip():
        out.append(current.strip())
    return out


def pack_paragraphs(text: str, most: int = 6000) -> list[str]:
    """Paragraphs (lines, blank lines ignored) joined by newlines while the chunk has at most ``most`` characters."""
    out: list[str] = []
    current = ""
    for part in re.split(r"\n\s*\n|\n", text):
        if current and len(current) + 1 + len(part) > most:
            out.append(current)
            current = part
        else:
            current = f"{current}\n{part}" if current else part
    return [*out, current] if current.strip() else out


def packed(batches: Iterator[pa.RecordBatch], pack: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """(doc_id, chunk_id, text) of batches of ids and texts; only 256 texts at a time are Python objects."""
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        ids, numbers, texts = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            made = pack(text or "")
            ids += [key] * len(made)
            numbers += range(len(made))
            texts += made
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_id", "text"])


def chunks(docs: DataFrame, strategy: str = "paragraphs", most: int | None = None, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, text): a fold over each document, in Arrow batches where it is read."""
    if strategy not in ("paragraphs", "sentences"):
        raise ValueError(strategy)

    pack = (lambda t: pack_paragraphs(t, most or 6000)) if strategy == "paragraphs" else (lambda t: pack_sentences(t, most or 2000, overlap))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lambda batches: packed(batches, pack), f"doc_id {kind}, chunk_id int, text string")


def token_offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, pos, token, start, end): tokens joined by blanks, each sentence followed by a newline."""
    before = Window.partitionBy("doc_id").orderBy("sent", "pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("token") + 1).over(before), F.lit(0))
    return tokens.select("doc_id", "sent", "pos", "token", start.alias("start"), (start + F.char_length("token")).alias("end"))


def sentences_text(sentences: Column) -> Column:
    """The same text of one document's sentences (arrays of tokens) as an array of one; of none, if no sentence has a token.

    Exploded, a document without tokens has no row.  What is used twice is a lambda's argument: Spark makes it once.
    """
    lines = F.transform(F.array(sentences), lambda xs: F.transform(F.filter(xs, lambda ts: F.size(ts) > 0), lambda ts: F.array_join(ts, " ", "")))
    return F.transform(F.filter(lines, lambda ls: F.size(ls) > 0), lambda ls: F.concat(F.array_join(ls, "\n"), F.lit("\n")))


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sent, pos, token) rows with each run of neighbours of a sentence, where they lie one after another, as one of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, sent, pos, token = batch.columns
        keys = [pc.equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False) for x in (doc, sent)]
        steps = pc.equal(pc.subtract(pos[1:], pos[:-1]), 1).fill_null(False).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(~(keys[0] & keys[1] & steps)) + 1])
        at = pa.array(starts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(token)), pa.int32()), token)
        yield pa.RecordBatch.from_arrays([*(x.take(at) for x in (doc, sent, pos)), pc.binary_join(lists, " ")], names=batch.schema.names)


def joined_text(tokens: DataFrame) -> DataFrame:
    """(doc_id, text) of the same."""
    # one exchange, of a row a document where its tokens lie together; three flat lists in one order are half as large as one of structs.
    # Runs come first: what an aggregation of tokens sorts when it has many documents grows past memory and spills
    whole = tokens.select("doc_id", "sent", "pos", F.coalesce("token", F.lit("")).cast("string").alias("token"))
    whole = whole.mapInArrow(joined_runs, whole.schema)
    lists = whole.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("sent", "pos", "token")))
    rows = lists.select("doc_id", F.array_sort(F.arrays_zip("sent", "pos", "token")).alias("xs"))
    between = lambda x, i: F.when(i == 0, "").when(F.get("xs", i - 1)["sent"] == x["sent"], " ").otherwise("\n")
    return rows.select("doc_id", F.concat(F.array_join(F.transform("xs", lambda x, i: F.concat(between(x, i), x["token"])), ""), F.lit("\n")).alias("text"))


def decode_spans(tags: DataFrame) -> DataFrame:
    """(doc_id, sent, label, first, last) of runs of equal labels; B- starts a run, O and empty tags close one."""
    order = Window.partitionBy("doc_id", "sent").orderBy("pos")
    rows = tags.withColumn("outside", F.coalesce(F.col("tag"), F.lit("")).isin("", "O"))
    rows = rows.withColumn("label", F.when(~F.col("outside"), F.when(F.col("tag").contains("-"), F.expr("substring(tag, instr(tag, '-') + 1)")).otherwise("")))
    begins = ~F.col("outside") & (F.col("tag").startswith("B-") | (F.col("tag") == "B") | ~F.coalesce(F.lag("label").over(order) == F.col("label"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(begins.cast("int")).over(order)).where("not outside")
    return rows.groupBy("doc_id", "sent", "run", "label").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def truncate(docs: DataFrame, most: int) -> DataFrame:
    """Gold documents cut at ``most`` characters.

    Mentions past the cut go; entities that had offsets and lost all of them go, and relations of theirs.
    """
    fits = lambda m: m["end"].isNull() | (m["end"] <= most)
    stays = lambda e: (F.size(e["mentions"]) > 0) | e["had"]
    flagged = F.transform("entities", lambda e: F.struct(*(e[f].alias(f) for f in ("id", "name", "type", "aliases")), F.filter(e["mentions"], fits).alias("mentions"), (~F.exists(e["mentions"], lambda m: m["start"].isNotNull())).alias("had")))
    rows = docs.withColumn("text", F.substring("text", 1, most)).withColumn("entities", F.filter(flagged, stays))
    ids = F.transform("entities", lambda e: e["id"])
    rows = rows.withColumn("relations", F.filter("relations", lambda r: F.array_contains(ids, r["source"]) & F.array_contains(ids, r["target"])))
    return rows.withColumn("entities", F.transform("entities", lambda e: F.struct(*(e[f].alias(f) for f in ("id", "name", "type", "aliases", "mentions")))))


def listing(entities: DataFrame, key: str, with_aliases: bool = True) -> DataFrame:
    """(key, listing): one line an entity, in order of ``pos``."""
    line = F.concat(F.lit("- "), F.col("canonical_name"), F.lit(" ("), F.col("entity_type"), F.lit(")"))
    if with_aliases:
        line = F.concat(line, F.when(F.size("aliases") > 0, F.concat(F.lit(" aka "), F.array_join("aliases", ", "))).otherwise(""))
    rows = entities.withColumn("line", line).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return rows.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("listing"))
