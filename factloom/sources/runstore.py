"""Stored runs: artifacts of the old format, predictions with their ledger, exports, the map of an evaluation's runs, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from . import files, loaders

#: Chunk settings that a manifest of the old format states.
CHUNK_MAX_CHARS, CHUNK_OVERLAP_CHARS = 2000, 200


def chunk_index(entities: DataFrame) -> DataFrame:
    """(run_id, entities) to (run_id, chunk_entity_index): chunk number to entity ids, one entry a citation, in order of entity and citation.

    Citations without a chunk aren't in it; a run without citations has no row.
    """
    cites = entities.select("run_id", F.posexplode("entities").alias("pos", "e")).select("run_id", "pos", F.col("e.entity_id").alias("id"), F.posexplode("e.citations").alias("n", "c"))
    cites = cites.select("run_id", "pos", "n", "id", F.col("c.chunk_id").alias("chunk_id")).where("chunk_id IS NOT NULL")
    by_chunk = cites.groupBy("run_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "id"))), lambda x: x["id"]).alias("ids"))
    return by_chunk.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").cast("string").alias("key"), F.col("ids").alias("value"))))).alias("chunk_entity_index"))


def save_manifests(runs: DataFrame, path: str) -> None:
    """(run_id, created_at, source_file, seed), a row a run; as with all artifacts, saving a run again replaces it."""
    rows = runs.select("run_id", "created_at", "source_file", "seed", F.lit(CHUNK_MAX_CHARS).alias("chunk_max_chars"), F.lit(CHUNK_OVERLAP_CHARS).alias("chunk_overlap_chars"))
    files.upsert(rows, f"{path}/manifest", "run_id", order="created_at")


def save_chunks(runs: DataFrame, path: str) -> None:
    """(run_id, chunks): a run has one document, so its arrays are bounded by it.  Null is no chunks."""
    files.upsert(runs.select("run_id", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks")), f"{path}/chunks", "run_id")


def save_entities(runs: DataFrame, path: str) -> None:
    """(run_id, validated_entities, entities): both lists, and for each chunk the canonical entities cited in it."""
    none = F.create_map().cast("map<string,array<string>>")
    rows = runs.select("run_id", "validated_entities", F.col("entities").alias("canonical_entities")).join(chunk_index(runs), "run_id", "left")
    files.upsert(rows.withColumn("chunk_entity_index", F.coalesce("chunk_entity_index", none)), f"{path}/entities", "run_id")


def save_outputs(runs: DataFrame, path: str) -> None:
    """(run_id, entities, relationships) as a finished run gives them."""
    files.upsert(runs.select("run_id", "entities", "relationships"), f"{path}/output", "run_id")


def load_artifact(spark: SparkSession, path: str, name: str, run_id: str | None = None) -> DataFrame:
    """The manifest, chunks, entities or output of all runs, or of one; a run that has none is a FileNotFoundError."""
    rows = files.read_keyed(spark, f"{path}/{name}").drop("bucket")
    if run_id is None:
        return rows
    rows = rows.where(F.col("run_id") == run_id)
    if rows.isEmpty():
        raise FileNotFoundError(f"no {name} of run {run_id!r}")
    return rows


def latest_run(spark: SparkSession, path: str) -> str:
    """The id of the run whose manifest is newest, of equal times the greatest; ValueError if there is none."""
    return load_artifact(spark, path, "manifest").agg(F.max(F.struct("created_at", "run_id")).alias("m")).select("m.run_id").first()[0]


def predictions(spark: SparkSession, path: str, ops_path: str | None = None, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, runs) of run folders below ``path``: predictions under their run's id, and each run's ledger where it has one.

    ``wanted`` (run_id) are the runs that must be there: one without output.json fails the job.
    """
    raw = spark.read.option("pathGlobFilter", "output.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    raw = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("doc_id"), F.col("value").alias("json"))
    return run_predictions(raw, files.read_ops(spark, ops_path or path), wanted)


def run_predictions(outputs: DataFrame, ledgers: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from outputs (doc_id, json) and ledger rows; of several ledgers of a run the latest started counts."""
    outputs = with_outputs(outputs, wanted)
    newest = ledgers.groupBy("run_id").agg(F.max_by(F.struct("status", "error", "latency_s", "llm"), F.struct("started_at", F.xxhash64("status", "error"))).alias("o")).select("run_id", "o.*")
    return (*generic_predictions(outputs), outputs.select(F.col("doc_id").alias("run_id")).join(newest, "run_id", "left"))


def with_outputs(raw: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """(doc_id, json) of the wanted runs, of all if none are named; a wanted run without output fails the job."""
    if wanted is None:
        return raw
    rows = wanted.select(F.col("run_id").alias("doc_id")).distinct().join(raw, "doc_id", "left")
    missing = F.raise_error(F.concat(F.lit("output.json missing: run did not complete: "), F.coalesce("doc_id", F.lit("null"))))
    return rows.select("doc_id", F.coalesce("json", missing).alias("json"))


def generic_predictions(raw: DataFrame, type_map: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of predictions of any system, given as (doc_id, json)."""
    return loaders.prediction_entities(raw, type_map), loaders.prediction_relations(raw)


def export(runs: DataFrame, eval_id: str, path: str) -> None:
    """Copy an evaluation's runs under <evaluation>__<run>, with what they have of manifest, output, document and ops; exporting again replaces them."""
    kept = [c for c in ("manifest", "output", "document", "ops") if c in runs.columns]
    rows = runs.select(F.concat(F.lit(f"{eval_id}__"), "run_id").alias("run_id"), *kept)
    files.upsert(rows, path, "run_id")


def write_run_map(runs: DataFrame, path: str) -> None:
    """(doc_id, run) of the runs of an evaluation that have an output."""
    runs.where("has_output").select("doc_id", "run").write.mode("overwrite").json(path)


def read_run_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, run string").json(path)


def newest_first(rows: DataFrame, time: str, key: str, after: tuple | None = None, size: int | None = None) -> DataFrame:
    """Rows newest first, equal times by key; a page of ``size`` rows after the (time, key) that the last page ended with."""
    if after is not None:
        at = F.lit(after[0]).cast(rows.schema[time].dataType)
        later = F.col(time).eqNullSafe(at) & (F.col(key) > F.lit(after[1]))  # rows without a time come last
        rows = rows.where(later if after[0] is None else later | (F.col(time) < at) | F.col(time).isNull())
    rows = rows.orderBy(F.desc_nulls_last(time), key)
    return rows if size is None else rows.limit(size)


def engine_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row a run: telemetry of its extraction (metadata.json) and counts of its provenance; runs without metadata have none.

    Nodes of the document itself aren't counted; a node is verbatim if any anchor is, with a span.
    """
    meta = "pipeline_version string, processing_time_seconds double, results struct<nodes:bigint,edges:bigint,dense:struct<phase1_seconds:double,phase2_seconds:double,chunk_coverage_pct:double,truncation_count:bigint,dropped_chunk_ids:array<bigint>,skeleton_batches_failed:bigint,retention_pct:double,skeleton_path_counts:map<string,bigint>>>, config map<string,string>"
    return telemetry(_per_run(spark, path, "metadata.json", meta), _per_run(spark, path, "provenance.json", S.PROVENANCE))


def _per_run(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Files of a name below <path>/<run_id>/."""
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return raw.withColumn("run_id", F.regexp_extract(F.substring_index("_metadata.file_path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "^([^/]+)", 1))


def telemetry(meta: DataFrame, provenance: DataFrame) -> DataFrame:
    """(run_id, metadata fields) and (run_id, nodes, chunks) to one row of telemetry a run."""
    dense, config = F.col("results.dense"), F.col("config")
    paths = F.transform_keys(F.coalesce(dense["skeleton_path_counts"], F.create_map().cast("map<string,bigint>")), lambda k, v: F.when(k == "", "(root)").otherwise(k))
    kept = ("use_chunking", "gleaning_enabled", "parallel_workers", "provenance", "structured_output", "resolved_model")
    rows = meta.select(
        "run_id", "pipeline_version", F.col("processing_time_seconds").alias("processing_s"), F.col("results.nodes").alias("nodes"), F.col("results.edges").alias("edges"), dense["phase1_seconds"].alias("phase1_s"), dense["phase2_seconds"].alias("phase2_s"),
        dense["chunk_coverage_pct"].alias("chunk_coverage_pct"), dense["truncation_count"].alias("truncations"), F.greatest(F.size(F.coalesce(dense["dropped_chunk_ids"], F.array().cast("array<bigint>"))), F.lit(0)).cast("bigint").alias("dropped_chunks"),
        dense["skeleton_batches_failed"].alias("skeleton_failed_batches"), dense["retention_pct"].alias("retention_pct"), paths.alias("skeleton_by_path"), F.map_filter(config, lambda k, v: k.isin(*kept)).alias("config"),
    )
    nodes = F.filter(F.map_values(F.coalesce("nodes", F.create_map().cast(provenance.schema["nodes"].dataType))), lambda n: ~n["node_type"].eqNullSafe("OntologyDocument"))
    verbatim = F.filter(nodes, lambda n: F.exists(F.coalesce(n["anchors"], F.array().cast("array<struct<document_id:string,chunk_id:int,kind:string,span:array<int>>>")), lambda a: a["kind"].eqNullSafe("verbatim") & (F.coalesce(F.size(a["span"]), F.lit(0)) > 0)))
    chunks = F.map_values(F.coalesce("chunks", F.create_map().cast(provenance.schema["chunks"].dataType)))
    counts = provenance.select("run_id", F.size(nodes).cast("bigint").alias("provenance_nodes"), F.size(verbatim).cast("bigint").alias("provenance_verbatim_nodes"), F.size(chunks).cast("bigint").alias("chunks"), F.aggregate(chunks, F.lit(0).cast("bigint"), lambda t, c: t + F.coalesce(c["token_count"], F.lit(0))).alias("chunk_tokens"))
    return rows.join(counts, "run_id", "left")


def history(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The stored history, of one dataset if it is named."""
    rows = files.read_history(spark, path)
    return rows if dataset is None else rows.where(F.col("dataset") == dataset)
