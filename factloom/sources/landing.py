"""Uploads: files landed under ids, listed, shown as text; archives opened into members that stay inside their folder."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# What a reader of uploads is told.
PDF_NOTE = "PDF rendering not implemented yet"
UNSUPPORTED_NOTE = "Unsupported file type"
MISSING_NOTE = "Upload not found"
# End of fixed values.

_MEMBER = "archive string, member string, path string, content binary"


def stored(rows: DataFrame) -> DataFrame:
    """(filename, content, uploaded_at, ...) with upload_id, stored_filename and size_bytes.

    The id is 8 hex digits of the hash of name and content, so a file landed again keeps its id.  Null content is empty; a null
    name is the empty one.
    """
    name, content = F.coalesce("filename", F.lit("")), F.coalesce("content", F.lit(""))
    upload_id = F.substring(F.sha2(F.concat(name, F.lit("/"), content), 256), 1, 8)
    rows = rows.withColumn("filename", name).withColumn("content", content).withColumn("upload_id", upload_id)
    return rows.withColumn("stored_filename", F.concat_ws("_", "upload_id", "filename")).withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def land(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Land files in a keyed table: one row a stored name, the newest; landing the same file twice leaves one."""
    files.upsert(stored(rows).select("stored_filename", "upload_id", "filename", "content", "size_bytes", "uploaded_at"), path, "stored_filename", order="uploaded_at", buckets=buckets)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Landed files without their content, newest first, equal times by stored name.  The id is what precedes the first underscore, the name all after it."""
    name = F.col("stored_filename")
    rows = files.read_keyed(spark, path).select(F.substring_index(name, "_", 1).alias("upload_id"), F.when(F.contains(name, F.lit("_")), F.expr("substring(stored_filename, instr(stored_filename, '_') + 1)")).otherwise(name).alias("filename"), name, "size_bytes", "uploaded_at")
    return rows.orderBy(F.desc("uploaded_at"), "stored_filename")


def views(requests: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(upload_id, status, type, content, message) for each requested id: .txt as text, a note for .pdf, 400 for other files, 404 for unknown ids.

    Suffixes count as they are written.  Of several files under an id, the first stored name is shown.  Repeated requests are answered each.
    """
    landed = files.read_keyed(spark, path).select("upload_id", "stored_filename", "content")
    suffix = F.regexp_extract("stored_filename", r"(\.[^./]+)$", 1)
    landed = landed.withColumn("suffix", suffix).groupBy("upload_id").agg(F.min_by(F.struct("suffix", F.when(F.col("suffix") == ".txt", F.col("content")).alias("content")), "stored_filename").alias("f"))
    kind = F.when(F.col("f.suffix") == ".txt", "text").when(F.col("f.suffix") == ".pdf", "pdf")
    note = F.when(F.col("f").isNull(), MISSING_NOTE).when(F.col("type") == "pdf", PDF_NOTE).when(F.col("type").isNull(), UNSUPPORTED_NOTE)
    status = F.when(F.col("f").isNull(), 404).when(F.col("type").isNull(), 400).otherwise(200)
    return requests.select("upload_id").join(landed, "upload_id", "left").withColumn("type", kind).select("upload_id", status.alias("status"), "type", F.col("f.content").alias("content"), note.alias("message"))


def inside(name: str) -> str | None:
    """A member's path below the folder it is unpacked in; None if it would leave it."""
    path = posixpath.normpath(name.replace("\\", "/"))
    return None if path.startswith("/") or path == ".." or path.startswith("../") else path


def members(archives: DataFrame, include: tuple[str, ...] = ("*",), strip: int = 0) -> DataFrame:
    """(archive, content) of zip archives to (archive, member, path, content, sha256, bytes), a row a file whose name fits a pattern.

    ``strip`` leading folders are cut from the path (the last part stays where there are fewer).  A member that would land outside
    the folder has a null path and no content; folders are skipped.  One archive is opened in one task, one member held at a time.
    """

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["archive"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith("/") or not any(fnmatch.fnmatchcase(name, g) for g in include):
                            continue
                        path = inside(name.split("/", strip)[-1])
                        yield pd.DataFrame({"archive": [archive], "member": [name], "path": [path], "content": [None if path is None else z.read(name)]})

    rows = archives.where("content IS NOT NULL").select("archive", "content").mapInPandas(opened, _MEMBER)
    return rows.withColumn("sha256", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content").cast("bigint"))


def unpack(archives: DataFrame, include: tuple[str, ...] = ("*",), strip: int = 0) -> DataFrame:
    """Members as above; one that would leave its folder fails the job."""
    rows = members(archives, include, strip)
    return rows.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("unsafe path in archive: "), "member"))))


def zipped(rows: DataFrame, most: int = 256) -> DataFrame:
    """(member, content) to zip archives (archive, content) of at most ``most`` files, made where the rows are."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), most):
                part, out = frame.iloc[at : at + most], io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in zip(part["member"], part["content"], strict=True):
                        z.writestr(name, content or "")
                yield pd.DataFrame({"archive": [f"{part['member'].iloc[0]}.zip"], "content": [out.getvalue()]})

    return rows.select("member", "content").mapInPandas(made, "archive string, content binary")


def write_lock(content: DataFrame, path: str) -> None:
    """(url, content) to a lock table (url, sha256, bytes): what was fetched, to compare with what is fetched again."""
    content.select("url", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes")).write.mode("overwrite").json(path)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, sha256 string, bytes bigint").json(path)


def changed(content: DataFrame, lock: DataFrame) -> DataFrame:
    """(url, state) of what differs from the lock: new, gone or changed."""
    now = content.select("url", F.sha2("content", 256).alias("now"))
    both = now.join(lock.select("url", "sha256"), "url", "full")
    state = F.when(F.col("sha256").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("url", state.alias("state")).where("state IS NOT NULL")
