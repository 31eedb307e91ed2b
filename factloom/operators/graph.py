"""Entity graph, register tables and their sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def build(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges (source, target, relation, pos) with both ends among the entities; of an ordered pair's the last stays."""
    ids = entities.select("entity_id")
    rows = relationships.withColumn("source", T.clean_id(F.col("source"))).withColumn("target", T.clean_id(F.col("target")))
    rows = rows.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")
    return rows.groupBy("source", "target").agg(F.max_by("relation", "pos").alias("relation"), F.max("pos").alias("pos"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Every entity with its number of edge ends."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))
    return entities.join(ends, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def anchored(citations):
    """Of an array of citations those with a real span."""
    return F.filter(citations, lambda c: c["end_char"] > c["start_char"])


def register(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Register sheet: name, type, aliases, anchored mentions, first quote, degree; by type and folded name."""
    rows = degrees(entities, edges).withColumn("_a", anchored(F.col("citations")))
    rows = rows.select("entity_id", "canonical_name", "entity_type", F.array_join("aliases", "; ").alias("aliases"), F.size("_a").cast("bigint").alias("mentions"), F.get("_a", F.lit(0))["quote"].alias("first_quote"), "degree")
    return rows.orderBy("entity_type", T.casefold(F.col("canonical_name")), "entity_id")


def relationship_sheet(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with names in place of ids; an id without an entity stays itself."""
    name = lambda c: entities.select(F.col("entity_id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
    rows = edges.join(name("source"), "source", "left").join(name("target"), "target", "left")
    return rows.select(F.coalesce("source_name", "source").alias("source"), "relation", F.coalesce("target_name", "target").alias("target"))


def evidence_sheet(entities: DataFrame) -> DataFrame:
    """One row per anchored citation."""
    rows = entities.select("entity_id", "canonical_name", F.explode(anchored(F.col("citations"))).alias("c"))
    return rows.select("entity_id", "canonical_name", "c.start_char", "c.end_char", "c.quote", T.citation_label(F.col("c.match")).alias("match"))


def cover(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of key figures."""
    a = entities.agg(
        F.count(F.lit(1)).alias("entities"),
        *(F.count_if(F.col("entity_type") == t).alias(f"n_{t}") for t in ("person", "company", "agreement")),
        F.count_if(~F.col("entity_type").isin("person", "company", "agreement")).alias("n_others"),
    )
    b = edges.agg(F.count(F.lit(1)).alias("relationships"), F.countDistinct("relation").alias("relation_types"))
    c = edges.select(F.explode(F.array("source", "target")).alias("e")).agg(F.countDistinct("e").alias("connected"))
    return a.crossJoin(b).crossJoin(c)  # single rows


def without_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Old edges and the new ones whose triple isn't among them."""
    keys = ["source", "relation", "target"]
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def drop_roots(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without document and relation-record nodes, and edges that start at a document."""
    return nodes.where(~F.col("__class__").isin("OntologyDocument", "Relationship")), edges.where(~F.contains("source", F.lit("OntologyDocument")))
