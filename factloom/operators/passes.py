"""Validation chains over proposals, and the extractor boundary.

What a language model would propose arrives as a table; everything after that is deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .anchor import allowed_direction, alnum_located, occurrences
from .automaton import find_forms


class Extractor(Protocol):
    """Turns chunks (doc_id, chunk_id, text) into proposals."""

    def proposals(self, chunks: DataFrame) -> DataFrame: ...


class Replay:
    """Proposals from a stored table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def proposals(self, chunks: DataFrame) -> DataFrame:
        return self.table.join(chunks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")


class RuleExtractor:
    """Runs of two and more capitalised words as entities, with their sentence as the quote."""

    pattern = r"\p{Lu}[\p{L}\p{N}&.'-]*(?:[ ]+\p{Lu}[\p{L}\p{N}&.'-]*)+"

    def proposals(self, chunks: DataFrame) -> DataFrame:
        names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({self.pattern})"), 1)))
        return chunks.select("doc_id", "chunk_id", names.alias("entity_name")).select("*", F.lit("other").alias("entity_type"), F.col("entity_name").alias("exact_quote"))


class Callback:
    """A function of a pandas frame of chunks; a failed batch yields nothing."""

    def __init__(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str):
        self.fn, self.schema = fn, schema

    def proposals(self, chunks: DataFrame) -> DataFrame:
        fn = self.fn

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                try:
                    yield fn(frame)
                except Exception:  # noqa: BLE001  the boundary is unreliable by contract
                    continue

        return chunks.mapInPandas(run, self.schema)


def present(chunks: DataFrame, entities: DataFrame, with_aliases: bool = True, least: int = 1) -> DataFrame:
    """(doc_id, chunk_id, entity_id) of entities of which a form of two or more letters is in the chunk.

    A chunk is scanned once, by the automaton of its document's forms.  Chunks with fewer than ``least`` such entities go,
    before any extractor sees them.
    """
    forms = F.concat(F.array("canonical_name"), "aliases") if with_aliases else F.array("canonical_name")
    keys = entities.select("doc_id", "entity_id", F.explode(forms).alias("form")).select("doc_id", "entity_id", T.norm_key(F.col("form")).alias("fk"))
    keys = keys.where(F.char_length("fk") >= (2 if with_aliases else 1))
    texts = chunks.select("doc_id", "chunk_id", T.norm_key(F.col("text")).alias("ck"))
    hits = find_forms(texts, keys.select("doc_id", F.col("entity_id").alias("id"), F.col("fk").alias("form")), text_col="ck", limit=1)
    found = hits.select("doc_id", "chunk_id", F.col("id").alias("entity_id")).distinct()
    if least > 1:
        enough = found.groupBy("doc_id", "chunk_id").count().where(F.col("count") >= least)
        found = found.join(enough, ["doc_id", "chunk_id"], "left_semi")
    return found


def check_relations(proposed: DataFrame, rules: DataFrame, require_evidence: bool = True) -> DataFrame:
    """Proposals with ``reject``: unresolved, bad_direction, no_evidence, duplicate, or null for those kept.

    ``proposed`` has (doc_id, pos, source, relation, target, source_type, target_type, start_char).  The first of equal
    triples that passes the other checks is kept.
    """
    rows = allowed_direction(proposed, rules)
    unresolved = F.col("source").isNull() | F.col("target").isNull() | (F.col("source") == F.col("target"))
    early = F.when(unresolved, "unresolved").when(~F.col("allowed"), "bad_direction")
    if require_evidence:
        early = early.when(F.col("start_char").isNull(), "no_evidence")
    rows = rows.withColumn("_early", early)
    order = Window.partitionBy("doc_id", "source", "relation", "target", F.col("_early").isNull()).orderBy("pos")
    return rows.withColumn("reject", F.coalesce("_early", F.when(F.row_number().over(order) > 1, "duplicate"))).drop("_early", "allowed")


def check_missed(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Recall proposals with ``reject``: not_in_text, duplicate, no_evidence, or null.

    ``proposed`` has (doc_id, pos, name, chunk, start_char), in place of the chunk's text its key as chunk_key; ``known`` the alias keys of the document's entities.  A name that
    an earlier kept proposal has is a duplicate.
    """
    rows = proposed.withColumn("name", T.strip(F.col("name"))).withColumn("k", T.alias_key(F.col("name")))
    nk = T.norm_key(F.col("name"))
    # what needs the chunk comes first, so that no chunk is exchanged with each of its names
    rows = rows.withColumn("_absent", (F.char_length(nk) < 2) | ~F.contains(F.col("chunk_key") if "chunk_key" in rows.columns else T.norm_key(F.col("chunk")), nk)).drop("chunk", "chunk_key")
    rows = rows.join(known.withColumn("_known", F.lit(True)), ["doc_id", "k"], "left")
    early = F.when(F.col("_absent"), "not_in_text").when(F.col("_known"), "duplicate")
    rows = rows.withColumn("_early", early).withColumn("_ok", F.col("_early").isNull() & F.col("start_char").isNotNull())
    before = Window.partitionBy("doc_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept_before = F.coalesce(F.max(F.col("_ok").cast("int")).over(before), F.lit(0)) > 0
    late = F.when(kept_before, "duplicate").when(F.col("start_char").isNull(), "no_evidence")
    return rows.withColumn("reject", F.coalesce("_early", late)).drop("_absent", "_early", "_ok", "_known")


def missed_citations(kept: DataFrame, docs: DataFrame, limit: int = 3) -> DataFrame:
    """Citations of kept recall proposals: the quote, and those of the first ``limit`` places of the name that are outside it."""
    quote = kept.select("doc_id", "name", "start_char", "end_char", F.lit("verbatim").alias("match"))
    inner = kept.select("doc_id", "name", F.col("start_char").alias("lo"), F.col("end_char").alias("hi")).join(docs.select("doc_id", "text"), "doc_id")
    named = occurrences(inner, "text", "name", ignore_case=False, limit=limit).where("not (lo <= start_char and start_char < hi)")
    return quote.unionByName(named.select("doc_id", "name", "start_char", "end_char", F.lit("name_search").alias("match")))


def locate_evidence(rows: DataFrame, text_col: str, quote_col: str) -> DataFrame:
    """start_char and end_char of quotes: exact in the JVM, else by letters and digits."""
    q = T.strip(F.col(quote_col))
    at = F.when(q == "", -1).otherwise(F.instr(F.col(text_col), q) - 1)
    rows = rows.withColumn("_at", at).withColumn("_q", q)
    loose = alnum_located(F.when(F.col("_at") < 0, F.col(text_col)), F.when(F.col("_at") < 0, F.col("_q")))
    rows = rows.withColumn("_loose", loose)
    start = F.when(F.col("_at") >= 0, F.col("_at")).otherwise(F.col("_loose.start"))
    return rows.withColumn("start_char", start).withColumn("end_char", F.when(F.col("_at") >= 0, F.col("_at") + F.char_length("_q")).otherwise(F.col("_loose.end"))).drop("_at", "_q", "_loose")


def pass_statistics(checked: DataFrame, reasons: list[str]) -> DataFrame:
    """(doc_id, proposed, kept, one column a reason)."""
    return checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("reject").isNull()).alias("kept"), *(F.count_if(F.col("reject") == r).alias(r) for r in reasons)
    )
