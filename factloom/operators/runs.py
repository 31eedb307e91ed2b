"""Whole runs: the passes after conversion, composed, and replays of single passes over stored runs.

Entities have (doc_id, entity_id, pos, canonical_name, entity_type, aliases, citations), relationships (doc_id, pos, source,
target, relation, start_char, end_char, quote, match), documents (doc_id, text).  What a model would propose is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as T
from ..sources.shared import laid_out, store
from . import aliasfold, convert, docrun, passes, resolve

_EDGE = ["doc_id", "pos", "source", "target", "relation", "start_char", "end_char", "quote", "match"]
_MARK = "\x1f"


def settle(entities: DataFrame, relations: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases that documents define, then entities of equal names merged and relationships moved to them; loops and repeats go.

    Entities lie by document, and only those that share a name with another (or an id) are labelled and merged; the others stay where they are.
    """
    local = laid_out(convert.alias_pass(entities, docs), "doc_id")
    key = lambda c: F.concat_ws(_MARK, F.col("doc_id").cast("string"), F.col(c))
    keyed = local.withColumn("entity_id", key("entity_id"))
    same = store(resolve.same_name_edges(keyed, keep=("doc_id",)))
    twice = keyed.groupBy("doc_id", "entity_id").count().where("count > 1").select("doc_id", "entity_id")
    met = same.select("doc_id", F.explode(F.array("a", "b")).alias("entity_id")).unionByName(twice).groupBy("doc_id").agg(F.collect_set("entity_id").alias("_met"))
    rows = keyed.join(met, "doc_id", "left").withColumn("_meets", F.coalesce(F.array_contains("_met", F.col("entity_id")), F.lit(False))).drop("_met")
    alone, keyed = rows.where("not _meets"), store(rows.where("_meets").drop("_meets"))
    comps = resolve.label_components(same.select("a", "b"), keyed.select(F.col("entity_id").alias("id")))
    merged = resolve.merge(keyed, comps)
    rows = keyed.join(comps.withColumnRenamed("id", "entity_id"), "entity_id").groupBy("comp").agg(
        F.first("doc_id").alias("doc_id"), F.min("pos").alias("pos"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entity_id", "citations"))), lambda x: x["citations"]))).alias("citations")
    )
    own = lambda c: F.element_at(F.split(c, _MARK), -1)
    names = F.array_distinct(F.concat(F.array("canonical_name"), "aliases"))
    kind = F.when(resolve.type_rank(F.col("entity_type")).isNotNull(), F.col("entity_type")).alias("entity_type")
    alone = alone.select("doc_id", own("entity_id").alias("entity_id"), "pos", "canonical_name", kind, F.filter(names, lambda n: n != F.col("canonical_name")).alias("aliases"), F.array_distinct("citations").alias("citations"))
    entities = laid_out(merged.join(rows, "comp").select("doc_id", own("comp").alias("entity_id"), "pos", "canonical_name", "entity_type", "aliases", "citations").unionByName(alone), "doc_id")
    end = lambda c: comps.select(F.col("id").alias(c), own("comp").alias(f"{c}_to"))
    moved = relations.withColumn("source", key("source")).withColumn("target", key("target")).join(end("source"), "source", "left").join(end("target"), "target", "left")
    moved = moved.withColumn("source", F.coalesce("source_to", own("source"))).withColumn("target", F.coalesce("target_to", own("target"))).where("source <> target")
    first = Window.partitionBy("doc_id", "source", "relation", "target").orderBy("pos", "start_char")
    return entities, store(moved.withColumn("n", F.row_number().over(first)).where("n = 1").select(*_EDGE))


def settle_in_order(entities: DataFrame, relations: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relationships, counters by document) of the order-dependent alias pass: the entity with more citations keeps its id."""
    folded = store(aliasfold.alias_fold(entities, docs))
    home = folded.select("doc_id", F.explode("members").alias("id"), F.col("entity_id").alias("to"))
    end = lambda c: home.select("doc_id", F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
    moved = relations.join(end("source"), ["doc_id", "source"], "left").join(end("target"), ["doc_id", "target"], "left")
    moved = moved.withColumn("source", F.coalesce("source_to", "source")).withColumn("target", F.coalesce("target_to", "target")).where("source <> target")
    first = Window.partitionBy("doc_id", "source", "relation", "target").orderBy("pos", "start_char")
    relations = moved.withColumn("n", F.row_number().over(first)).where("n = 1").select(*_EDGE)
    return folded.select(*entities.columns), relations, folded.select("doc_id", *aliasfold.STATISTICS).distinct()


def recall_pass(entities: DataFrame, docs: DataFrame, chunks: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with the missed ones, checked proposals).

    ``proposals`` has (doc_id, chunk_id, pos, name, type, quote).  A name must be in its chunk and new, its quote in the text.
    """
    rows = passes.locate_evidence(proposals.join(docs.select("doc_id", "text"), "doc_id"), "text", "quote").drop("text")
    rows = rows.join(chunks.select("doc_id", "chunk_id", T.norm_key(F.col("text")).alias("chunk_key")), ["doc_id", "chunk_id"])
    checked = laid_out(passes.check_missed(rows, resolve.known_keys(entities)).drop("k"), "doc_id")
    new = checked.where("reject is null")
    cites = passes.missed_citations(new.select("doc_id", "name", "start_char", "end_char"), docs).join(docs, "doc_id")
    cites = cites.withColumn("quote", F.expr("substring(text, start_char + 1, end_char - start_char)"))
    cites = cites.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "quote", "match"))).alias("citations"))
    last = entities.groupBy("doc_id").agg(F.max("pos").alias("last"))
    added = new.join(cites, ["doc_id", "name"]).join(last, "doc_id", "left")
    added = added.select(
        "doc_id", T.recall_id(F.col("name")).alias("entity_id"), (F.coalesce("last", F.lit(0)) + 1 + F.col("pos")).alias("pos"), F.col("name").alias("canonical_name"), F.col("type").alias("entity_type"), F.array().cast("array<string>").alias("aliases"), "citations"
    )
    return entities.select(*added.columns).unionByName(added), checked


def relation_pass(entities: DataFrame, relations: DataFrame, docs: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships with the new ones, checked proposals).

    ``proposals`` has (doc_id, pos, subject, relation, object, quote).  Both names must be of known entities, the direction allowed,
    the quote in the text, and the triple new.
    """
    forms = entities.select("doc_id", "entity_id", "pos", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("form"))
    found = resolve.match_name(proposals.select("doc_id", F.explode(F.array("subject", "object")).alias("name")), forms).join(entities.select("doc_id", "entity_id", "entity_type"), ["doc_id", "entity_id"], "left")
    end = lambda name, to: found.select("doc_id", F.col("name").alias(name), F.col("entity_id").alias(to), F.col("entity_type").alias(f"{to}_type"))
    rows = proposals.join(end("subject", "source"), ["doc_id", "subject"], "left").join(end("object", "target"), ["doc_id", "object"], "left")
    rows = passes.locate_evidence(rows.join(docs, "doc_id"), "text", "quote")
    rows = rows.withColumn("quote", F.expr("substring(text, start_char + 1, end_char - start_char)")).drop("text")
    checked = store(passes.check_relations(rows, S.rules_table(entities.sparkSession)))
    keys = ["doc_id", "source", "relation", "target"]
    new = checked.where("reject is null").join(relations.select(*keys).distinct(), keys, "left_anti").withColumn("match", F.lit("verbatim"))
    return relations.select(*_EDGE).unionByName(new.select(*_EDGE)), checked


def run(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, chunks: DataFrame, docs: DataFrame, missed: DataFrame | None, related: DataFrame | None) -> dict[str, DataFrame]:
    """Conversion, alias pass, recall pass with aliases again, relation pass; a pass without proposals is left out.

    After conversion a document is a row that goes through all passes (``docrun``), with the results of ``settle``, ``recall_pass`` and
    ``relation_pass`` one after another; documents and chunks laid out by doc_id aren't moved again.
    """
    entities, relations = convert.convert_documents(nodes, edges, anchors, chunks, docs)
    return docrun.run(entities, laid_out(relations, "doc_id"), chunks, docs, missed, related)


def replay_recall(stored: dict[str, DataFrame], docs: DataFrame, chunks: DataFrame, missed: DataFrame) -> dict[str, DataFrame]:
    """The recall pass alone over a stored run, merged again; what was stored stays as it is."""
    entities, checked = recall_pass(stored["entities"], docs, chunks, missed)
    entities, relations = settle(entities, stored["relationships"], docs)
    return {"entities": entities, "relationships": relations, "missed": checked}


def replay_relations(stored: dict[str, DataFrame], docs: DataFrame, related: DataFrame, keep: bool = True) -> dict[str, DataFrame]:
    """The relation pass alone over stored entities; with ``keep`` off the stored relationships are made anew."""
    old = stored["relationships"] if keep else stored["relationships"].limit(0)
    relations, checked = relation_pass(stored["entities"], old, docs, related)
    return {"entities": stored["entities"], "relationships": relations, "related": checked}
