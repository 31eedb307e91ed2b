"""Queries of uploads, archives, datasets and stored runs: what the tables hold is landed in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import datasets, files, landing, runstore
from ..sources.shared import shared_path
from . import inputs as I

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


_FILES = """files AS (SELECT page_id, 'page_' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.txt' END AS filename, coalesce(html, '') AS content FROM pages),
landed AS (SELECT *, substring(sha256(filename || '/' || content), 1, 8) AS upload_id FROM files)"""


def _files(spark, d) -> DataFrame:
    """All pages as files of three kinds, a second apart."""
    name = F.expr("concat('page_', page_id, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.txt' END)")
    return I.table(spark, d, "pages").select("page_id", name.alias("filename"), F.col("html").alias("content"), F.timestamp_seconds("page_id").alias("uploaded_at"))


@query("a03_upload_listing", f"WITH {_FILES} SELECT upload_id, filename, upload_id || '_' || filename AS stored_filename, CAST(strlen(content) AS BIGINT) AS size_bytes, make_timestamp(page_id * 1000000) AS uploaded_at FROM landed")
def a03(spark, d) -> DataFrame:
    """All pages landed, then listed newest first."""
    path = shared_path(spark, "uploads")
    landing.land(_files(spark, d), path)
    return landing.listing(spark, path).withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp_ntz"))


@query("a04_upload_views", f"""WITH {_FILES}, asked AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'no' || page_id ELSE upload_id END AS upload_id FROM landed)
SELECT upload_id, CAST(CASE WHEN filename IS NULL THEN 404 WHEN filename LIKE '%.html' THEN 400 ELSE 200 END AS BIGINT) AS status, CASE WHEN filename LIKE '%.txt' THEN 'text' WHEN filename LIKE '%.pdf' THEN 'pdf' END AS type,
CASE WHEN filename LIKE '%.txt' THEN content END AS content, CASE WHEN filename IS NULL THEN '{landing.MISSING_NOTE}' WHEN filename LIKE '%.html' THEN '{landing.UNSUPPORTED_NOTE}' WHEN filename LIKE '%.pdf' THEN '{landing.PDF_NOTE}' END AS message
FROM asked LEFT JOIN landed USING (upload_id)""")
def a04(spark, d) -> DataFrame:
    """Every page asked for by its upload's id, every fifth by one that doesn't exist."""
    path = shared_path(spark, "uploads")
    landing.land(_files(spark, d), path)
    asked = landing.stored(_files(spark, d)).select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("no"), "page_id")).otherwise(F.col("upload_id")).alias("upload_id"))
    return landing.views(asked, spark, path).withColumn("status", F.col("status").cast("bigint"))


@query("a20_archive_members", """WITH m AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 9 = 0 THEN 'corpus/../../' || doc_id || '.txt' ELSE 'corpus/docs/' || doc_id || '.txt' END AS member FROM documents)
SELECT member, CASE WHEN doc_id % 9 <> 0 THEN 'docs/' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS sha256, CAST(CASE WHEN doc_id % 9 <> 0 THEN strlen(text) END AS BIGINT) AS bytes FROM m""")
def a20(spark, d) -> DataFrame:
    """All documents zipped and unpacked, every ninth under a name that would leave the folder."""
    path = shared_path(spark, "archives")
    name = F.expr("concat(CASE WHEN doc_id % 9 = 0 THEN 'corpus/../../' ELSE 'corpus/docs/' END, doc_id, '.txt')")
    landing.zipped(I.table(spark, d, "documents").select(name.alias("member"), F.col("text").alias("content"))).write.parquet(path)
    return landing.members(spark.read.parquet(path), include=("corpus/*.txt",), strip=1).select("member", "path", "sha256", "bytes")


@query("k08_fetch_lock", """SELECT url || '#' || page_id AS url, CASE page_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'gone' END AS state FROM pages WHERE NOT (page_id % 3 = 1 AND page_id % 2 = 0)""")
def k08_lock(spark, d) -> DataFrame:
    """Two thirds of the pages were fetched; a third is new now, a third gone, and half of the rest has changed: what the lock tells."""
    path = shared_path(spark, "lock")
    rows = I.table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"), F.coalesce("html", F.lit("")).alias("content"))
    landing.write_lock(rows.where("page_id % 3 <> 0"), path)
    now = rows.where("page_id % 3 <> 2").withColumn("content", F.when(F.col("page_id") % 2 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return landing.changed(now, landing.read_lock(spark, path))


def _gold(spark, d) -> DataFrame:
    none = [F.array().cast(t).alias(c) for c, t in (("entities", "array<struct<id:string>>"), ("relations", "array<struct<source:string>>"))]
    return I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", *none)


@query("a21_prepared_by_name", """SELECT via, 'corpus' AS dataset, cast(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents, (VALUES ('name'), ('folder')) AS v(via)""")
def a21(spark, d) -> DataFrame:
    """All documents as a prepared dataset, found by its name and by its folder."""
    root = shared_path(spark, "datasets")
    files.write_prepared(_gold(spark, d), f"{root}/corpus/prepared", {"name": "corpus"})
    by_name, name = datasets.resolve_gold(spark, "corpus", root)
    by_folder = datasets.prepared(spark, f"{root}/corpus/prepared", root)
    rows = by_name.select(F.lit("name").alias("via"), "doc_id", "text").unionByName(by_folder.select(F.lit("folder").alias("via"), "doc_id", "text"))
    return rows.select("via", F.lit(name).alias("dataset"), "doc_id", F.char_length("text").cast("bigint").alias("n_chars"))


@query("a19_card_catalogue", """SELECT 'set-' || page_id AS name, CASE page_id % 2 WHEN 0 THEN 'native' ELSE 'conll' END AS loader, page_id % 3 <> 0 AS has_coref, true AS has_types, CASE WHEN page_id % 3 = 0 THEN 'company' END AS types FROM pages""")
def a19(spark, d) -> DataFrame:
    """A card a page, a third with coverage of its own, read into the catalogue; the first version of each is superseded."""
    path = shared_path(spark, "cards")
    cover = F.expr("CASE WHEN page_id % 3 = 0 THEN 'has_coref: false\\nexhaustive_entity_types: [company]\\n' ELSE '' END")
    name = F.concat(F.lit("name: set-"), "page_id", F.lit("\nloader: "))
    old, new = F.concat(name, F.lit("old\n")), F.concat(name, F.expr("CASE page_id % 2 WHEN 0 THEN 'native' ELSE 'conll' END"), F.lit("\n"), cover)
    version = lambda v, text: F.struct(F.concat(F.lit(f"{v}/set-"), "page_id", F.lit(".yaml")).alias("path"), text.alias("text"))
    I.table(spark, d, "pages").select(F.inline(F.array(version("v1", old), version("v2", new)))).write.parquet(path)
    found = datasets.catalogue(spark.read.parquet(path))
    return found.select("name", "loader", "coverage.has_coref", "coverage.has_types", F.array_join("coverage.exhaustive_entity_types", ",").alias("types"))


@query("a18_gold_by_card", f"WITH {I.NAMES} SELECT DISTINCT doc_id, true AS has_types, false AS has_coref, true AS exhaustive_relations FROM names")
def a18(spark, d) -> DataFrame:
    """Gold of all documents of names read as a card says; each document carries the card's coverage, its gaps filled."""
    path = shared_path(spark, "by_card")
    gold = I.names(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("g"), "k").alias("id"), "name", "type"))).alias("entities"))
    gold.write.json(path)
    rows = datasets.from_card(spark, {"name": "names", "loader": "native", "has_coref": False}, path)
    return rows.select("doc_id", F.col("coverage.has_types").alias("has_types"), F.col("coverage.has_coref").alias("has_coref"), F.col("coverage.exhaustive_relations").alias("exhaustive_relations"))


_LINES = """lines AS (SELECT doc_id, CAST(unnest(generate_series(0, len(ls) - 1)) AS BIGINT) AS chunk_id, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
firsts AS (SELECT *, regexp_extract(line, '[A-Za-z0-9]+') AS name FROM lines)"""


@query("k01_artifacts", f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS run_id, doc_id || '.txt' AS source_file, chunk_id, line AS chunk, CASE WHEN name <> '' THEN name END AS entity_ids FROM firsts""")
def k01(spark, d) -> DataFrame:
    """Artifacts of a run for each document saved and loaded: lines as chunks, the first word of each an entity, equal words one.

    Every chunk with its run's source file and the entities that the index gives for it.
    """
    path = shared_path(spark, "artifacts")
    runs = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run_id"), F.split("text", "\n").alias("chunks"))
    firsts = F.transform("chunks", lambda x, i: F.struct(F.regexp_extract(x, "[A-Za-z0-9]+", 0).alias("name"), i.alias("chunk_id")))
    words = runs.select("run_id", F.inline(F.filter(firsts, lambda x: x["name"] != "")))
    ents = words.groupBy("run_id", "name").agg(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda c: F.struct(c.alias("chunk_id"))).alias("citations"))
    ents = ents.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("entity_id"), F.col("name").alias("canonical_name"), "citations"))).alias("entities"))
    manifests = runs.select("run_id", F.lit("2024-01-01T00:00:00").alias("created_at"), F.concat("run_id", F.lit(".txt")).alias("source_file"), F.lit(42).alias("seed"))
    runstore.save_manifests(manifests, path)
    runstore.save_chunks(runs, path)
    runstore.save_entities(ents.withColumn("validated_entities", F.transform("entities", lambda e: F.struct(e["canonical_name"].alias("name")))), path)
    chunks = runstore.load_artifact(spark, path, "chunks").select("run_id", F.posexplode("chunks").alias("chunk_id", "chunk"))
    index = runstore.load_artifact(spark, path, "entities").select("run_id", F.explode("chunk_entity_index").alias("k", "ids")).select("run_id", F.col("k").cast("int").alias("chunk_id"), F.array_join("ids", ",").alias("entity_ids"))
    rows = chunks.join(index, ["run_id", "chunk_id"], "left").join(runstore.load_artifact(spark, path, "manifest").select("run_id", "source_file"), "run_id")
    return rows.select("run_id", "source_file", F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk", "entity_ids")


@query("a11_generic_predictions", f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'e' || chunk_id AS id, name, CASE chunk_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'other' END AS type FROM firsts""")
def a11(spark, d) -> DataFrame:
    """A prediction file's JSON for each document, field names of three systems, ids in brackets or not."""
    path = shared_path(spark, "generic")
    lines = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("ls"))
    word = lambda x: F.regexp_extract(x, "[A-Za-z0-9]+", 0)
    entity = lambda x, i: F.struct(
        F.when(i % 2 == 0, F.concat(F.lit("[e"), i, F.lit("]"))).alias("entity_id"), F.when(i % 2 == 1, F.concat(F.lit("e"), i)).alias("id"), F.when(i % 2 == 0, word(x)).alias("canonical_name"), F.when(i % 2 == 1, word(x)).alias("name"),
        F.when(i % 3 == 0, "Company").alias("entity_type"), F.when(i % 3 == 1, "PERSON").alias("type"),
    )
    lines.select("doc_id", F.to_json(F.struct(F.transform("ls", entity).alias("entities"))).alias("json")).write.parquet(path)
    return runstore.generic_predictions(spark.read.parquet(path))[0].select("doc_id", "id", "name", "type")


@query("k12_export", """SELECT 'eval1__' || page_id AS run_id, CASE WHEN page_id % 2 = 0 THEN url END AS output, coalesce(html, '') AS document FROM pages""")
def k12(spark, d) -> DataFrame:
    """A run a page exported under its evaluation, and every second one again with an output."""
    path = shared_path(spark, "export")
    rows = I.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("run_id"), F.lit(None).cast("string").alias("output"), F.coalesce("html", F.lit("")).alias("document"), "page_id", "url", F.lit("x").alias("log"))
    runstore.export(rows, "eval1", path)
    runstore.export(rows.where("page_id % 2 = 0").withColumn("output", F.col("url")), "eval1", path)
    return files.read_keyed(spark, path).select("run_id", "output", "document")


@query("k08_run_map", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'runs/' || doc_id AS run FROM documents WHERE n_chars >= 400")
def k08_map(spark, d) -> DataFrame:
    """The runs of all documents, short ones failed, as the map that scoring reads."""
    path = shared_path(spark, "run_map")
    rows = I.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("runs/"), "doc_id").alias("run"), (F.col("n_chars") >= 400).alias("has_output"))
    runstore.write_run_map(rows, path)
    return runstore.read_run_map(spark, path)


@query("s02_newest_runs", "SELECT user_id AS run_id, max(ts) AS started_at FROM events GROUP BY 1")
def s02(spark, d) -> DataFrame:
    """All runs of the event table, newest first."""
    rows = I.table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("started_at"))
    return runstore.newest_first(rows, "started_at", "run_id")


@query("a23_engine_stats", """WITH n AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT CAST(doc_id AS VARCHAR) AS run_id, CAST(len(ls) AS BIGINT) AS nodes, CAST(doc_id % 4 AS BIGINT) AS dropped_chunks, CAST(len(ls) AS BIGINT) AS provenance_nodes,
CAST(len(list_filter(ls, lambda x: length(x) % 2 = 0)) AS BIGINT) AS provenance_verbatim_nodes, CAST(len(ls) AS BIGINT) AS chunks, CAST(list_sum(list_transform(ls, lambda x: length(x))) AS BIGINT) AS chunk_tokens, CAST(len(ls) AS BIGINT) AS at_root FROM n""")
def a23(spark, d) -> DataFrame:
    """Metadata and provenance of an extraction of each document (a node a line, and the document's own) to telemetry."""
    lines = I.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("run_id"), F.split("text", "\n").alias("ls"))
    size = F.size("ls").cast("bigint")
    dense = F.struct(F.when(F.col("doc_id") % 4 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("doc_id") % 4)).alias("dropped_chunk_ids"), *(F.lit(None).cast(t).alias(n) for n, t in (("phase1_seconds", "double"), ("phase2_seconds", "double"), ("chunk_coverage_pct", "double"), ("truncation_count", "bigint"), ("skeleton_batches_failed", "bigint"), ("retention_pct", "double"))), F.create_map(F.lit(""), size).alias("skeleton_path_counts"))
    meta = lines.select("run_id", F.lit("1").alias("pipeline_version"), F.lit(1.0).alias("processing_time_seconds"), F.struct(size.alias("nodes"), F.lit(0).cast("bigint").alias("edges"), dense.alias("dense")).alias("results"), F.create_map(F.lit("provenance"), F.lit("true")).alias("config"))
    anchor = lambda x, i: F.struct(F.lit("d").alias("document_id"), i.alias("chunk_id"), F.lit("verbatim").alias("kind"), F.when(F.char_length(x) % 2 == 0, F.array(F.lit(0), F.lit(1))).alias("span"))
    node = lambda x, i: F.struct(F.concat(F.lit("n"), i).alias("key"), F.struct(F.lit("Company").alias("node_type"), F.array(anchor(x, i)).alias("anchors")).alias("value"))
    own = F.struct(F.lit("root").alias("key"), F.struct(F.lit("OntologyDocument").alias("node_type"), F.array(anchor(F.lit("ab"), F.lit(0))).alias("anchors")).alias("value"))
    chunk = lambda x, i: F.struct(i.cast("string").alias("key"), F.struct(i.alias("chunk_id"), F.char_length(x).alias("token_count")).alias("value"))
    provenance = lines.select("run_id", F.map_from_entries(F.concat(F.transform("ls", node), F.array(own))).alias("nodes"), F.map_from_entries(F.transform("ls", chunk)).alias("chunks"))
    rows = runstore.telemetry(meta, provenance)
    return rows.select("run_id", "nodes", "dropped_chunks", "provenance_nodes", "provenance_verbatim_nodes", "chunks", "chunk_tokens", F.col("skeleton_by_path")["(root)"].alias("at_root"))


@query("a10_run_predictions", f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS run_id, count(*) FILTER (name <> '') AS entities, CASE WHEN doc_id % 3 = 0 THEN 'completed' END AS status, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 / 10.0 END AS cost_usd FROM firsts GROUP BY doc_id""")
def a10(spark, d) -> DataFrame:
    """The output of a run for each document, every third with a ledger: all runs wanted, with what they predict and cost."""
    path = shared_path(spark, "predictions")
    docs = I.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("run_id"), F.split("text", "\n").alias("ls"))
    words = F.filter(F.transform("ls", lambda x: F.regexp_extract(x, "[A-Za-z0-9]+", 0)), lambda w: w != "")
    docs.select(F.col("run_id").alias("doc_id"), F.to_json(F.struct(F.transform(words, lambda w: F.struct(w.alias("name"))).alias("entities"))).alias("json")).write.parquet(f"{path}/outputs")
    ledgers = docs.where("doc_id % 3 = 0").select("run_id", F.lit("completed").alias("status"), F.struct((F.col("doc_id") % 100 / 10.0).alias("cost_usd")).alias("llm"))
    ledgers.write.json(f"{path}/ops")
    ents, _, runs = runstore.run_predictions(spark.read.parquet(f"{path}/outputs"), files.read_ledger(spark, f"{path}/ops"), docs.select("run_id"))
    counts = ents.groupBy(F.col("doc_id").alias("run_id")).agg(F.count(F.lit(1)).alias("entities"))
    return runs.join(counts, "run_id", "left").select("run_id", F.coalesce("entities", F.lit(0).cast("bigint")).alias("entities"), "status", F.col("llm.cost_usd").alias("cost_usd"))


@query("a24_history", "SELECT 'e' || page_id AS eval_id, 'set1' AS dataset, CAST(page_id AS VARCHAR) AS docs FROM pages WHERE page_id % 3 = 1")
def a24(spark, d) -> DataFrame:
    """An evaluation a page of three datasets appended to the history, then read for one of them."""
    path = shared_path(spark, "history")
    rows = I.table(spark, d, "pages").select(F.concat(F.lit("e"), "page_id").alias("eval_id"), F.concat(F.lit("set"), F.col("page_id") % 3).alias("dataset"), F.col("page_id").alias("docs"))
    files.append_history(rows, path)
    return runstore.history(spark, path, "set1").select("eval_id", "dataset", "docs")
