"""The converter: extraction graphs with provenance to entities with anchored citations and relationships, many documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import laid_out, store
from . import anchor, graph, resolve


def convert(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, chunks: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of one document; ``ref`` is one row (text).  Relationships without both ends go."""
    one = lambda df: df.withColumn("doc_id", F.lit("doc"))
    entities, relations = convert_documents(one(nodes), one(edges), one(anchors), one(chunks), one(ref))
    relations = relations.select("source", "target", "relation")
    for end in ("source", "target"):
        relations = relations.join(entities.select(F.col("entity_id").alias(end)), end, "left_semi")
    return entities.drop("doc_id", "pos"), relations


def convert_documents(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, chunks: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of all documents; every table has doc_id.

    ``nodes`` and ``edges`` are graph tables, ``anchors`` and ``chunks`` those of provenance files, ``refs`` has the texts.  Document
    roots and relation records are no entities; citations are verbatim anchors, else places of the name, else none.
    Edges keep the tightest passage that cites both ends as evidence.  Relation records (nodes with subject, object, relation
    and evidence) become relationships if both names are of known, different entities: their evidence is looked up
    in the text, else the passage of both ends counts.

    Texts are joined by document for each of these; ``refs`` that are laid out by doc_id (``shared.laid_out``) aren't moved for it.
    """
    entities = laid_out(convert_entities(nodes, anchors, chunks, refs), "doc_id")
    nodes, edges = _numbered(nodes), _numbered(edges)
    links, docs = graph.drop_roots(nodes, edges)[1], refs.select("doc_id", "text")
    relations = links.select("doc_id", "pos", "source", "target", F.lower("label").alias("relation"), F.lit(None).cast("string").alias("evidence"))
    if "subject" in nodes.columns:
        relations = relations.unionByName(relation_records(nodes.where("label = 'Relationship'"), entities))
    return entities, with_evidence(relations, entities, docs)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows if "pos" in rows.columns else rows.withColumn("pos", F.lit(0).cast("long"))


def convert_entities(nodes: DataFrame, anchors: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """The entities of ``convert_documents`` alone; they don't depend on edges and relation records."""
    nodes = _numbered(nodes)
    kept = graph.drop_roots(nodes, nodes.select("doc_id", F.col("id").alias("source"), F.col("id").alias("target")))[0]
    ents = kept.select("doc_id", "id", "name", "ontology_type", "aliases", "label", "pos")
    docs = refs.select("doc_id", "text")
    keys = anchors.where("kind = 'verbatim' and lo is not null").join(chunks.select("doc_id", "chunk_id", F.col("text").alias("chunk_text")), ["doc_id", "chunk_id"])
    keys = anchor.span_quotes(keys.select("doc_id", F.col("node_type").alias("label"), "name", "chunk_text", F.col("lo").alias("span_start"), F.col("hi").alias("span_end"))).drop("chunk_text")
    spans = ents.join(keys, ["doc_id", "label", "name"]).drop("label", "name", "ontology_type", "aliases", "pos").withColumnRenamed("id", "entity_id")
    placed = anchor.place_spans(spans.join(docs.withColumnRenamed("text", "ref"), "doc_id"))
    cites = anchor.citation_chain(ents.select("doc_id", F.col("id").alias("entity_id"), "name"), placed.select("doc_id", "entity_id", "start_char", "end_char", "quote"), docs)
    grouped = cites.groupBy("doc_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "quote", "match"))).alias("citations"))
    out = ents.withColumnRenamed("id", "entity_id").join(grouped, ["doc_id", "entity_id"], "left")
    return out.select("doc_id", "entity_id", "pos", F.col("name").alias("canonical_name"), F.col("ontology_type").alias("entity_type"), "aliases", "citations")


def relation_records(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, pos, source, target, relation, evidence) of records whose names are of two known entities."""
    forms = entities.select("doc_id", "entity_id", "pos", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    asked = records.select("doc_id", F.explode(F.array("subject", "object")).alias("name"))
    found = resolve.match_name(asked, forms)
    end = lambda name, to: found.select("doc_id", F.col("name").alias(name), F.col("entity_id").alias(to))
    rows = records.join(end("subject", "source"), ["doc_id", "subject"]).join(end("object", "target"), ["doc_id", "object"])
    return store(rows.where("source <> target").select("doc_id", "pos", "source", "target", F.coalesce("relation", F.lit("related_to")).alias("relation"), "evidence"))


def with_evidence(relations: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Relationships with start_char, end_char, quote and match: their own quote's place, else the passage that cites both ends, else none."""
    quoted = anchor.locate_quotes(relations.where("trim(evidence) <> ''").join(docs, "doc_id"), "text", "evidence")
    quoted = store(quoted.where("start_char is not null").select("doc_id", "pos", "source", "target", "relation", "start_char", "end_char", "quote", "match"))
    keys = ["doc_id", "pos", "source", "target", "relation"]
    rest = relations.select(*keys).join(quoted.select(*keys), keys, "left_anti")
    cites = entities.select("doc_id", "entity_id", F.posexplode("citations").alias("pos", "c")).select("doc_id", "entity_id", "pos", "c.start_char", "c.end_char")
    both = anchor.cooccurrence(rest.select("doc_id", "source", "target").distinct(), cites, docs).withColumn("match", F.lit("cooccurrence"))
    found = rest.join(both, ["doc_id", "source", "target"], "left")
    none = {"start_char": F.lit(0), "end_char": F.lit(0), "quote": F.lit(""), "match": F.lit("unanchored")}
    return quoted.unionByName(found.select(*keys, *(F.coalesce(c, v).alias(c) for c, v in none.items())))


def alias_pass(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities with the aliases that their documents define for them, unless another entity has that key."""
    terms = resolve.owners(resolve.defined_terms(docs), entities).where("entity_id is not null")
    taken = resolve.known_keys(entities).withColumnRenamed("k", "ak")
    new = terms.withColumn("ak", T.alias_key(F.col("alias"))).join(taken, ["doc_id", "ak"], "left_anti")
    added = new.groupBy("doc_id", "entity_id").agg(F.array_sort(F.collect_set("alias")).alias("defined"))
    rows = entities.join(added, ["doc_id", "entity_id"], "left")
    names: Column = F.array_distinct(F.concat("aliases", F.coalesce("defined", F.array().cast("array<string>"))))
    return rows.withColumn("aliases", F.filter(names, lambda a: a != F.col("canonical_name"))).drop("defined").select(*entities.columns)
