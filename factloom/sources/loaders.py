"""Loaders: raw label formats and predictions to gold and prediction tables.

Every loader takes (spark, path, options) and returns (doc_id, text, entities, relations); look them up by name with
``load``.  Files of one document are read whole by Spark, a file a row; line formats are read in splits of any size.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as T
from ..operators import chunk
from . import linefiles
from .shared import shared_path, store

LOADERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {}
GOLD_ROWS = S.GOLD.split(", coverage")[0]


def register(name: str):
    def add(fn):
        LOADERS[name] = fn
        return fn

    return add


def load(spark: SparkSession, name: str, path: str, options: dict | None = None, coverage: dict | None = None) -> DataFrame:
    """Gold documents of a registered loader, each with the card's coverage; an unknown name is a KeyError."""
    if name not in LOADERS:
        raise KeyError(f"unknown loader {name!r}; known: {sorted(LOADERS)}")
    rows = LOADERS[name](spark, path, options or {})
    return rows.withColumn("coverage", F.from_json(F.lit(json.dumps(coverage or {})), S.COVERAGE))


def group_mentions(mentions: DataFrame) -> DataFrame:
    """(doc_id, pos, text, type, start, end) to entities (doc_id, id, name, type, aliases, mentions): equal keys and types are one.

    The first text names it; ids number the entities of a document by first appearance; mentions without letters go.
    """
    rows = mentions.withColumn("_k", T.norm_name(F.col("text"))).where("_k <> ''")
    found = rows.groupBy("doc_id", "_k", "type").agg(F.min("pos").alias("_first"), F.min_by("text", "pos").alias("name"), F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end"))).alias("m"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")) - 1
    return found.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#e"), number.cast("string")).alias("id"), "name", "type",
        F.array().cast("array<string>").alias("aliases"), F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("mentions"),
    )


def gather(texts: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) with entities and relations as arrays."""
    e = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "type", "aliases", "mentions"))).alias("entities"))
    rows = texts.join(e, "doc_id", "left")
    none = F.array().cast("array<struct<source:string,type:string,target:string,evidence:string>>")
    if relations is not None:
        rows = rows.join(relations.groupBy("doc_id").agg(F.collect_list(F.struct("source", "type", "target", "evidence")).alias("relations")), "doc_id", "left")
    else:
        rows = rows.withColumn("relations", none)
    return rows.select("doc_id", "text", F.coalesce("entities", F.array().cast(f"array<struct<id:string,name:string,type:string,aliases:array<string>,mentions:array<{S.MENTION}>>>")).alias("entities"), F.coalesce("relations", none).alias("relations"))


def _type_of(label: Column, options: dict) -> Column:
    """The card's type of a label: mapped, dropped (null) where the map says null or has other labels only, else by synonym."""
    table = options.get("type_map")
    if not table:
        return T.norm_type(label)
    pairs = [x for k, v in table.items() if v is not None for x in (F.lit(str(k).lower()), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.lower(T.strip(label))) if pairs else F.lit(None).cast("string")


@register("native")
def native(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """One gold document a line."""
    return spark.read.schema(S.GOLD).json(path).drop("coverage", "meta")


def conll_tokens(spark: SparkSession, path: str, marker="-DOCSTART-", sep=" ", per=40, head=False) -> DataFrame:
    """(path, doc, sent, pos, token, tag) of files of a token and tag a line, read in splits of any size.

    Blank lines end sentences.  A marker line starts a document; before a file's first one every ``per`` sentences are one.
    Lines are numbered where they are read and stored once, with a row of ends a split; what a split needs of those before
    it is folded from these rows alone, so no token is exchanged.  With ``head`` there is also the document's first
    token, null before a file's first marker.
    """
    kind = F.when(F.startswith("value", F.lit(marker)), linefiles.MARK).when(T.strip(F.col("value")) == "", linefiles.BLANK).otherwise(linefiles.TOKEN)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("path"), F.col("_metadata.file_block_start").alias("split"), kind.cast("byte").alias("kind"), "value")
    at = shared_path(spark, "lines")
    lines.mapInArrow(linefiles.numbered, linefiles.NUMBERED).write.option("compression", "zstd").parquet(at)
    stored = spark.read.schema(linefiles.NUMBERED).parquet(at)

    ends = stored.where("end is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("split", "end"))).alias("ends")).where(F.size("ends") > 1)
    before = ends.mapInPandas(linefiles.carried, linefiles.CARRIED)
    rows = stored.where("end is null").join(F.broadcast(before), ["path", "split"], "left")  # a row for each further split of a file
    known = lambda c, v: F.coalesce(c, F.lit(v))
    q, m, here = F.col("q") + known("shift", 0), F.col("m") + known("marks", 0), F.col("begin") >= 0
    first = F.when(known("known_first", -1) >= 0, F.col("known_first")).otherwise(F.col("first") + known("shift", 0))
    doc = F.when(m == 0, F.floor(q / per)).otherwise(F.ceil(first / per) + m - 1)
    begin = F.when(m == 0, doc * per).when(here, F.col("begin") + known("shift", 0)).otherwise(F.col("known_begin"))
    rows = rows.withColumn("doc", doc.cast("int")).withColumn("sent", (q - begin).cast("int"))
    rows = rows.withColumn("pos", F.col("pos") + F.when(F.col("q") == 0, known("open", 0)).otherwise(0)).withColumn("head", F.when(here, F.col("head")).otherwise(F.col("known_head")))

    def split_up(line: str) -> tuple[Column, Column]:
        left = F.when(F.instr(line, sep) > 0, F.expr(f"left({line}, char_length({line}) - char_length(substring_index({line}, '{sep}', -1)) - {len(sep)})")).otherwise("")
        left = T.strip(left)
        return F.when(left == "", T.strip(F.col(line))).otherwise(left), T.strip(F.substring_index(line, sep, -1))

    token, tag = split_up("value")
    return rows.select("path", "doc", "sent", "pos", token.alias("token"), tag.alias("tag"), *([split_up("head")[0].alias("head")] if head else []))


@register("conll")
def conll(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Token and tag a line; blank lines end sentences; a marker starts a document, else every 40 sentences are one."""
    rows = conll_tokens(spark, path, options.get("doc_marker", "-DOCSTART-"), options.get("sep") or " ", int(options.get("sentences_per_doc", 40)))
    rows = store(rows.withColumn("doc_id", F.concat(F.lit(options.get("name", "conll")), F.lit("-"), F.lpad(F.col("doc").cast("string"), 4, "0"))))
    offsets = chunk.token_offsets(rows)
    spans = chunk.decode_spans(rows.select("doc_id", "sent", "pos", "tag")).withColumn("type", _type_of(F.col("label"), options)).where("type is not null")
    spans = spans.join(offsets.select("doc_id", "sent", F.col("pos").alias("first"), "start"), ["doc_id", "sent", "first"]).join(offsets.select("doc_id", "sent", F.col("pos").alias("last"), "end"), ["doc_id", "sent", "last"])
    texts = chunk.joined_text(rows)
    mentions = spans.join(texts, "doc_id").select("doc_id", F.col("start").alias("pos"), F.expr("substring(text, start + 1, `end` - start)").alias("text"), "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return gather(texts, group_mentions(mentions))


@register("docred")
def docred(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Sentences of tokens, entities as vertex sets with token positions, labels between them."""
    schema = "title string, sents array<array<string>>, vertexSet array<array<struct<name:string,pos:array<int>,sent_id:int,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
    raw = spark.read.schema(schema).option("multiLine", options.get("multi_line", True)).json(path).withColumnRenamed("title", "doc_id")
    tokens = raw.select("doc_id", F.posexplode("sents").alias("sent", "ts")).select("doc_id", "sent", F.posexplode("ts").alias("pos", "token"))
    offsets, texts = chunk.token_offsets(tokens), chunk.joined_text(tokens)
    ments = raw.select("doc_id", F.posexplode("vertexSet").alias("v", "ms")).select("doc_id", "v", F.posexplode("ms").alias("n", "m")).select("doc_id", "v", "n", F.col("m.name").alias("name"), F.col("m.sent_id").alias("sent"), F.col("m.pos")[0].alias("first"), (F.col("m.pos")[1] - 1).alias("last"), F.col("m.type").alias("label"))
    ments = ments.join(offsets.select("doc_id", "sent", F.col("pos").alias("first"), "start"), ["doc_id", "sent", "first"]).join(offsets.select("doc_id", "sent", F.col("pos").alias("last"), "end"), ["doc_id", "sent", "last"])
    pronouns = F.lower("name").isin("he", "she", "it", "they", "him", "her", "them", "his", "its", "their", "who", "which", "that")
    rows = ments.withColumn("name", T.detok(F.col("name"))).withColumn("type", _type_of(F.col("label"), options)).where(F.col("type").isNotNull() & ~pronouns)
    names = F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"])
    ents = rows.groupBy("doc_id", "v").agg(F.array_distinct(names).alias("ns"), F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("name").alias("text")))).alias("ms"))
    ents = ents.select("doc_id", F.concat(F.lit("v"), F.col("v").cast("string")).alias("id"), F.col("ns")[0].alias("name"), "type", F.slice("ns", 2, 1000).alias("aliases"), F.transform("ms", lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"))).alias("mentions"))
    table = options.get("relation_map") or {}
    mapped = [(k, v["type"] if isinstance(v, dict) else v, bool(isinstance(v, dict) and v.get("flip"))) for k, v in table.items() if v is not None]
    rels = raw.select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.h", "l.t", "l.r")
    if mapped:
        rels = rels.join(F.broadcast(spark.createDataFrame(mapped, "r string, type string, flip boolean")), "r")
    else:
        rels = rels.select("*", T.norm_rel(F.col("r")).alias("type"), F.lit(False).alias("flip"))
    end = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    rels = rels.select("doc_id", F.when(F.col("flip"), end("t")).otherwise(end("h")).alias("source"), "type", F.when(F.col("flip"), end("h")).otherwise(end("t")).alias("target"), F.lit("").alias("evidence"))
    known = ents.select("doc_id", "id")
    rels = rels.join(known.withColumnRenamed("id", "source"), ["doc_id", "source"], "left_semi").join(known.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_semi")
    return gather(texts, ents, rels)


@register("squad")
def squad(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Answers of the questions whose id ends with the wanted label are mentions; the span is that of the stripped answer."""
    schema = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    paras = raw.select(F.col("d.title").alias("doc_id"), F.posexplode("d.paragraphs").alias("n", "p")).select("doc_id", "n", F.col("p.context").alias("text"), "p.qas")
    paras = paras.withColumn("doc_id", F.concat("doc_id", F.lit("#"), F.col("n").cast("string")))
    rows = paras.select("doc_id", "text", F.explode("qas").alias("q")).where(F.endswith("q.id", F.lit(f"__{options.get('label', 'Parties')}"))) if options.get("label") else paras.select("doc_id", "text", F.explode("qas").alias("q"))
    rows = rows.select("doc_id", F.posexplode("q.answers").alias("i", "a")).withColumn("t", T.strip(F.col("a.text")))
    lead = F.char_length("a.text") - F.char_length(F.regexp_replace("a.text", "^(?U)\\s+", ""))
    start = F.col("a.answer_start") + lead
    ments = rows.select("doc_id", start.alias("pos"), F.col("t").alias("text"), F.lit(options.get("type", "company")).alias("type"), start.alias("start"), (start + F.char_length("t")).alias("end"))
    return gather(paras.select("doc_id", "text"), group_mentions(ments))


@register("textract")
def textract(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """LINE blocks joined by newlines; typed entities without offsets."""
    schema = "Blocks array<struct<BlockType:string,Text:string>>, Entities array<struct<Text:string,Type:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("doc_id"))
    texts = raw.select("doc_id", F.array_join(F.transform(F.filter("Blocks", lambda b: b["BlockType"] == "LINE"), lambda b: b["Text"]), "\n").alias("text"))
    ments = raw.select("doc_id", F.posexplode("Entities").alias("pos", "e")).select("doc_id", "pos", F.col("e.Text").alias("text"), _type_of(F.col("e.Type"), options).alias("type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")).where("type is not null")
    return gather(texts, group_mentions(ments))


@register("legacy")
def legacy(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Entities by name, relationships by names.  Of equal keys the later entity owns the id; ends that no entity has are added as "other".

    A file is a document, named in its path; with ``lines`` a line is one, with its doc_id, and files have as many as they like.
    """
    schema = "entities array<struct<entity_name:string,entity_type:string,aliases:array<string>>>, relationships array<struct<source:string,relationship:string,target:string>>"
    if options.get("lines"):
        raw = spark.read.schema(f"doc_id string, {schema}").json(path)
    else:
        raw = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.regexp_extract("_metadata.file_path", options.get("id_pattern", "([^/]+?)(?:\\.gt)?\\.json$"), 1).alias("doc_id"))
    ents = raw.select("doc_id", F.posexplode("entities").alias("pos", "e")).select("doc_id", "pos", F.concat(F.lit("g"), F.col("pos").cast("string")).alias("id"), F.col("e.entity_name").alias("name"), T.norm_type(F.col("e.entity_type")).alias("type"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"))
    by_key = ents.groupBy("doc_id", T.norm_name(F.col("name")).alias("k")).agg(F.max_by("id", "pos").alias("id"))
    rels = raw.select("doc_id", F.posexplode("relationships").alias("n", "r")).select("doc_id", "n", F.col("r.source").alias("s"), F.col("r.target").alias("t"), T.norm_rel(F.col("r.relationship")).alias("type"))
    ends = rels.select("doc_id", F.explode(F.array("s", "t")).alias("name")).withColumn("k", T.norm_name(F.col("name")))
    added = ends.join(by_key, ["doc_id", "k"], "left_anti").groupBy("doc_id", "k").agg(F.min("name").alias("name")).withColumn("id", F.concat(F.lit("implied-"), "k"))
    ids = by_key.unionByName(added.select("doc_id", "k", "id"))
    all_ents = ents.select("doc_id", "id", "name", "type", "aliases").unionByName(added.select("doc_id", "id", "name", F.lit("other").alias("type"), F.array().cast("array<string>").alias("aliases")))
    key = lambda c, out: ids.select("doc_id", F.col("k").alias(f"k{c}"), F.col("id").alias(out))
    done = rels.withColumn("ks", T.norm_name(F.col("s"))).withColumn("kt", T.norm_name(F.col("t"))).join(key("s", "source"), ["doc_id", "ks"]).join(key("t", "target"), ["doc_id", "kt"])
    texts = raw.select("doc_id", F.lit(options.get("text", "")).alias("text"))
    none = F.array().cast(f"array<{S.MENTION}>")
    return gather(texts, all_ents.withColumn("mentions", none), done.select("doc_id", "source", "type", "target", F.lit("").alias("evidence")))


def best_text(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Of several candidate texts (doc_id, path, text) that with the most of the document's names in it, of equals the first path."""
    hits = candidates.join(names.select("doc_id", "name").distinct(), "doc_id", "left").groupBy("doc_id", "path").agg(F.count_if(F.contains("text", F.col("name"))).alias("hits"))
    best = hits.groupBy("doc_id").agg(F.min_by("path", F.struct(-F.col("hits"), "path")).alias("path"))
    return candidates.join(best, ["doc_id", "path"], "left_semi")


# --- predictions -----------------------------------------------------------------------------------------------------

_CITE = "struct<start_char:int,end_char:int,quote:string>"
_PREDICTION = (
    f"entities array<struct<entity_id:string,id:string,canonical_name:string,name:string,entity_type:string,type:string,aliases:array<string>,citations:array<{_CITE}>>>,"
    f" relationships array<struct<source_entity_id:string,source:string,target_entity_id:string,target:string,relationship_type:string,type:string,quote:string,citation:{_CITE}>>,"
    f" relations array<struct<source_entity_id:string,source:string,target_entity_id:string,target:string,relationship_type:string,type:string,quote:string,citation:{_CITE}>>"
)


def _some(*cols: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))


def prediction_entities(raw: DataFrame, type_map: dict | None = None) -> DataFrame:
    """(doc_id, json) to (doc_id, id, name, type, aliases, quotes, spans); several field names are understood."""
    rows = raw.select("doc_id", F.explode(F.from_json("json", _PREDICTION)["entities"]).alias("e")).select("doc_id", "e.*")
    name = F.coalesce(_some("canonical_name", "name"), F.lit(""))
    aliases = F.coalesce(F.filter("aliases", lambda a: a.isNotNull() & (a != "") & (a != name)), F.array().cast("array<string>"))
    cites = F.coalesce("citations", F.array().cast(f"array<{_CITE}>"))
    spans = F.transform(F.filter(cites, lambda c: c["end_char"] > c["start_char"]), lambda c: F.struct(c["start_char"].alias("start"), c["end_char"].alias("end")))
    kind = T.norm_type(F.coalesce(_some("entity_type", "type"), F.lit("other")), type_map)
    return rows.select("doc_id", T.clean_id(_some("entity_id", "id", "canonical_name", "name")).alias("id"), name.alias("name"), kind.alias("type"), aliases.alias("aliases"), F.transform(cites, lambda c: F.coalesce(c["quote"], F.lit(""))).alias("quotes"), spans.alias("spans"))


def prediction_relations(raw: DataFrame) -> DataFrame:
    """(doc_id, json) to (doc_id, source, relation, target, quote)."""
    parsed = F.from_json("json", _PREDICTION)
    rows = raw.select("doc_id", F.explode(F.coalesce(parsed["relationships"], parsed["relations"])).alias("r")).select("doc_id", "r.*")
    return rows.select("doc_id", T.clean_id(F.coalesce("source_entity_id", "source", F.lit(""))).alias("source"), T.norm_rel(F.coalesce("relationship_type", "type", F.lit(""))).alias("relation"), T.clean_id(F.coalesce("target_entity_id", "target", F.lit(""))).alias("target"), F.coalesce("citation.quote", "quote", F.lit("")).alias("quote"))


def dataset_id(rows: DataFrame) -> str:
    """First 12 hex digits of the hash of all documents' ids and texts, in order of id; the fold is by hash, not by order."""
    folded = rows.select(F.xxhash64("doc_id", "text").alias("h")).agg(F.bit_xor("h"), F.count(F.lit(1)), F.sum(F.col("h") % 1_000_003)).first()
    import hashlib

    return hashlib.sha256(repr(tuple(folded)).encode()).hexdigest()[:12]


def cards(path: str) -> dict[str, dict]:
    """Dataset cards by name from YAML files of a local folder."""
    from pathlib import Path

    import yaml

    found = {}
    for p in sorted(Path(path).glob("*.y*ml")):
        card = yaml.safe_load(p.read_text(encoding="utf-8"))
        found[card.get("name", p.stem)] = card
    return found


