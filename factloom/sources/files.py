"""File sources and sinks of uploads, runs, graphs and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as T
from .shared import store


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt files, one row a file.  PDF raises NotImplementedError, other suffixes ValueError."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix == "pdf":
        raise NotImplementedError("PDF text extraction needs an external parser")
    if suffix and suffix != "txt":
        raise ValueError(f"unsupported file type: .{suffix}")
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, newest first: upload_id is what comes before the first underscore, filename all after it."""
    rows = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    stored = F.substring_index("path", "/", -1)
    rows = rows.withColumn("stored_filename", stored)
    return rows.select(
        F.substring_index("stored_filename", "_", 1).alias("upload_id"), F.expr("substring(stored_filename, instr(stored_filename, '_') + 1)").alias("filename"), "stored_filename", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at")
    ).orderBy(F.desc("uploaded_at"), "upload_id")


def upload_view(rows: DataFrame) -> DataFrame:
    """(stored_filename, text) with what a reader shows: text of .txt, a note for .pdf, null for the rest."""
    low = F.lower("stored_filename")
    return rows.withColumn("view", F.when(F.endswith(low, F.lit(".txt")), F.col("text")).when(F.endswith(low, F.lit(".pdf")), "PDF preview isn't available."))


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node rows of an extraction graph, the JSON cell parsed; a null cell is an empty object."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    cell = F.from_json(F.coalesce(F.col("`__provenance__`"), F.lit("{}")), S.PROVENANCE_CELL)
    label = F.col("entity_type") if "entity_type" in raw.columns else F.lit(None).cast("string")
    aliases = F.col("merged_aliases") if "merged_aliases" in raw.columns else F.lit(None).cast("string")
    return raw.select("*", T.entity_type(label, F.col("label")).alias("ontology_type"), T.cell_aliases(aliases, F.col("name")).alias("aliases"), cell.alias("provenance"))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="source string, target string, label string")


def provenance(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(anchors, chunks) of provenance files: (node_key, node_type, name, pos, chunk_id, kind, lo, hi) and (chunk_id, text).

    A file is a document; with ``lines`` a line is one, and files have as many as they like.
    """
    raw = spark.read.schema(S.PROVENANCE).option("multiLine", not lines).json(path)
    nodes = raw.select(F.explode("nodes").alias("node_key", "n")).select("node_key", "n.node_type", F.col("n.ids.name").alias("name"), F.posexplode("n.anchors").alias("pos", "a"))
    anchors = nodes.select("node_key", "node_type", "name", "pos", "a.chunk_id", "a.kind", F.get("a.span", F.lit(0)).alias("lo"), F.get("a.span", F.lit(1)).alias("hi"))
    chunks = raw.select(F.explode("chunks").alias("k", "c")).select("c.chunk_id", "c.text")
    return anchors, chunks


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, entities, relationships) of finished runs below a folder; a run without output.json isn't finished."""
    raw = spark.read.schema(S.OUTPUT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "output.json").json(path)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id"), "entities", "relationships")


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.OPS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "ops.json").json(path)


def write_ops(runs: DataFrame, path: str) -> None:
    """A ledger file a run, of finished and failed runs alike; writing a run again replaces it alone.

    ``runs`` has run_id and any of the ledger's other fields.  For very many runs use ``upsert`` with run_id as key: the same, in some files.
    """
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files as ``write_ops`` leaves them."""
    return spark.read.schema(S.OPS).json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """One partition a run; writing a run again replaces it alone."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def write_prepared(gold: DataFrame, path: str, card: dict) -> None:
    """gold as JSON lines, texts as files, the card beside them; what was there goes."""
    gold.write.mode("overwrite").json(f"{path}/gold")
    gold.select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/docs")
    gold.sparkSession.createDataFrame([(json.dumps(card, ensure_ascii=False, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/card")


HISTORY = """eval_id dataset created_at docs missing entity_f1_strict entity_f1_lenient entity_precision entity_recall relation_f1_strict relation_f1_undirected relation_f1_pair
relation_recall_strict typing_accuracy alias_recall coref_conll_f1 coref_b3_f1 quote_verbatim_rate placeholder_quote_rate unsupported_entity_rate grounding_rate
duplicate_entity_rate direction_violation_rate dangling_relation_rate orphan_entity_rate cost_usd latency_s failed_runs""".split()


def append_history(rows: DataFrame, path: str) -> None:
    """Fixed columns in fixed order; missing ones are null, others are left out."""
    cols = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in HISTORY]
    rows.select(*cols).write.mode("append").option("header", True).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in HISTORY))


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Register, relationships, evidence and cover as CSV folders."""
    for name, df in sheets.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(seq, bucket, version, buckets) of all committed writes; None before the first."""
    try:
        return spark.read.schema("seq bigint, bucket int, version string, buckets int").parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table as of its last commit, with their bucket; what no commit names isn't read."""
    commits = _commits(spark, path)
    if commits is None:
        raise ValueError(f"no committed table at {path}")
    newest = commits.groupBy("bucket").agg(F.max_by("version", "seq").alias("version"))
    return spark.read.option("mergeSchema", True).parquet(f"{path}/data").join(newest, ["version", "bucket"]).drop("version")


def upsert(rows: DataFrame, path: str, key: str, order: str | None = None, buckets: int = 64) -> None:
    """Merge rows into a keyed table: one row a key, the newest by ``order`` (else the greatest) of those given, in place of the old.

    Keys are hashed to ``buckets`` (as the first write said; a bucket is written by one task, so give them a task's data each).  Only buckets with new rows are written, as a new version of
    each; one append then commits them all.  A write that stops before it leaves the table as it was, and repeating a write
    changes nothing.  One writer at a time; null is a key like others.
    """
    spark = rows.sparkSession
    commits = _commits(spark, path)
    seq, made = commits.agg(F.max("seq"), F.max("buckets")).first() if commits is not None else (None, None)
    buckets = made or buckets
    rest = [F.col(c).desc_nulls_last() for c in ([order] if order else []) + [c for c, t in rows.dtypes if c not in (key, order) and not t.startswith("map")]]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket")  # the window and the write need no other exchange
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("bucket", key).orderBy(*rest) if rest else Window.partitionBy("bucket", key).orderBy(key))).where("_n = 1").drop("_n")
    version = f"v{uuid.uuid4().hex}"
    data = f"{path}/data/version={version}"
    if commits is None:
        best.write.partitionBy("bucket").parquet(data)
        touched = sorted(r[0] for r in spark.read.schema(best.schema).parquet(data).select("bucket").distinct().collect())
    else:
        best = store(best)
        touched = sorted(r[0] for r in best.select("bucket").distinct().collect())
    if not touched:
        return
    if commits is not None:
        old = read_keyed(spark, path).where(F.col("bucket").isin(touched))
        new = best.select(F.col(key).alias("_key"))
        out = old.join(new, old[key].eqNullSafe(new["_key"]), "left_anti").unionByName(best, allowMissingColumns=True)
        out.repartition("bucket").write.partitionBy("bucket").parquet(data)
    done = spark.createDataFrame([((seq or 0) + 1, b, version, buckets) for b in touched], "seq bigint, bucket int, version string, buckets int")
    done.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def append_scores(scores: DataFrame, path: str) -> None:
    """Keyed upsert: the old rows whose score_id isn't pushed again, and the new ones."""
    spark = scores.sparkSession
    try:
        old = spark.read.parquet(path)
        scores = old.join(scores.select("score_id"), "score_id", "left_anti").unionByName(scores).checkpoint() if spark.sparkContext.getCheckpointDir() else old.join(scores.select("score_id"), "score_id", "left_anti").unionByName(scores).persist()
        scores.count()
    except Exception as e:  # the first push has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    scores.write.mode("overwrite").parquet(path)


def audit_runs(runs: DataFrame) -> DataFrame:
    """(run_id, problem) of runs with missing keys or aliases that are no text."""
    bad = F.exists("entities", lambda e: e["entity_id"].isNull() | e["canonical_name"].isNull())
    alias = F.exists("entities", lambda e: F.exists(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: a.isNull()))
    problems = F.filter(F.array(F.when(F.col("entities").isNull(), "no entities"), F.when(F.col("relationships").isNull(), "no relationships"), F.when(bad, "entity without id or name"), F.when(alias, "alias isn't text")), lambda p: p.isNotNull())
    return runs.select("run_id", F.explode(problems).alias("problem"))


def content_lock(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of downloaded files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def render_report(metrics: dict[str, float | None], title: str = "Evaluation") -> str:
    """A Markdown report of one row of metrics; null is "n/a", never 0."""
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |"]
    lines += [f"| {k} | {'n/a' if v is None else f'{v:.4f}' if isinstance(v, float) else v} |" for k, v in metrics.items()]
    return "\n".join(lines) + "\n"
