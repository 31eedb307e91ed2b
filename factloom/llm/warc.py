"""WARC archives: writing captures, and assembling them again from request, response and metadata records.

Writing uses Spark's own text writer: a record is one row whose bytes end before the closing blank line, and the line
separator is that blank line, so the files are valid WARC/1.1 wherever the session can write.  Files are gzip
compressed and hold about ``file_bytes`` of payload each.

Every capture has three records: request, response or revisit, metadata.  The request and metadata records name the
response in WARC-Concurrent-To.  Of captures with equal payloads of at least ``revisit_from`` bytes the one with the
smallest id holds the payload; the others are revisit records of profile identical-payload-digest that refer to it.

Reading parses whole files by their Content-Length fields, one file at a time (memory: one compressed and one inflated
file), recomputes payload digests, and joins the records of a capture through the concurrent-to identifiers.

Rows of equal id, target and payload are collapsed before anything is compared, so a record's id follows from its row's values and
the number of the repeat, and a page that many rows repeat moves once a task.  Only ids and digests are joined to find the
payload's holder; payloads move once when written, and not at all when records are assembled without them.

Defined results: a null payload is empty; a null target is an empty one; a null id is written as an empty one, read back as
null, and is a response or a revisit of a named one; an empty table writes and reads nothing; rows that repeat an id are captures
of their own; line breaks in a target become %0A and %0D; records of unknown kinds are read but join no capture; requests or
metadata without a response make no capture; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, require, shared_path

BREAK = "\r\n"
RECORDS = (
    "record_id string, record_type string, concurrent_to string, target string, refers_to string, date string,"
    " content_type string, declared_digest string, http_length long, block binary, payload binary, payload_digest string, payload_length long"
)


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: each 5 hex digits are 4 letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    part = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    letters = [F.substring(alphabet, F.shiftright(part(i), s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(8) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: str, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """The bytes of one record without the blank line that ends it."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    parts: list[Column] = [F.lit(f"WARC/1.1{BREAK}WARC-Type: {kind}{BREAK}")]
    for name, value in fields:
        parts += [F.lit(f"{name}: "), text(value), F.lit(BREAK)]
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK + BREAK)]
    return F.concat(*(F.encode(p, "utf-8") for p in parts), block)


def write(captures: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", revisit_from=0, date="2024-01-01T00:00:00Z", file_bytes=24 << 20) -> str:
    """Writes three records a row below ``path`` and returns it."""
    require(captures, id_col, url_col, payload_col)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8") if dict(captures.dtypes)[payload_col] != "binary" else F.coalesce(F.col(payload_col), F.encode(F.lit(""), "utf-8"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = captures.select(F.col(id_col).alias("number"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = ["id", "url", "sha"]
    light = rows.where(F.col("n") >= revisit_from).select("number", *same).distinct()
    first = F.struct(F.col("number").isNull().alias("unnamed"), "number", "id", "url")
    owners = light.groupBy("sha").agg(F.min(first).alias("owner"), F.max(first).alias("last")).where("owner.id <> last.id").select("sha", "owner")
    refer = light.join(owners, "sha").where("owner.id <> id").select(*same, "owner")
    rows = rows.groupBy(*same).agg(F.first("payload").alias("payload"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
    rows = rows.join(refer, same, "left").withColumn("again", F.col("owner").isNotNull()).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))

    urn = lambda ident, url, row, kind: F.concat(F.lit("<urn:capture:"), ident, F.lit(":"), F.hex(F.xxhash64(url, F.col("sha"))), F.lit(":"), row.cast("string"), F.lit(f":{kind}>"))
    mine = lambda kind: urn(F.col("id"), F.col("url"), F.col("row"), kind)
    me = mine("response")
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1)
    target = F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]+", "")
    ask = F.encode(F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK + BREAK)), "utf-8")
    http = F.encode(F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("n").cast("string"), F.lit(BREAK + BREAK)), "utf-8")
    note = F.encode(F.concat(F.lit("captureId: "), F.col("id"), F.lit(BREAK)), "utf-8")
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    digests = [("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    refers = urn(F.col("owner.id"), F.col("owner.url"), F.lit(0), "response")
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    request = _record("request", [("WARC-Record-ID", mine("request")), ("WARC-Concurrent-To", me), *common, ("Content-Type", "application/http; msgtype=request")], ask)
    full = _record("response", [("WARC-Record-ID", me), *common, *digests], F.concat(http, F.col("payload")))
    short = _record("revisit", [("WARC-Record-ID", me), *common, *digests, ("WARC-Refers-To", refers), ("WARC-Profile", profile)], http)
    meta = _record("metadata", [("WARC-Record-ID", mine("metadata")), ("WARC-Concurrent-To", me), *common, ("Content-Type", "application/warc-fields")], note)
    gap = F.encode(F.lit(BREAK + BREAK), "utf-8")
    value = F.concat(request, gap, F.when(F.col("again"), short).otherwise(full), gap, meta)
    total, count = captures.agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)), F.count(F.lit(1))).first()
    per_file = max(1, int(count * file_bytes / max(total, 1))) if count else 1
    (
        rows.select(value.cast("string").alias("value"))
        .write.option("lineSep", BREAK + BREAK)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .mode("overwrite")
        .text(path)
    )
    return path


_HEADER_END = re.compile(rb"\r?\n\r?\n")


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, gzip compressed (in one or many members) or not; a damaged end is left out."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            inflate = zlib.decompressobj(31)
            try:
                parts.append(inflate.decompress(data) + inflate.flush())
            except zlib.error:
                break
            data = inflate.unused_data
        data = b"".join(parts)
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = _HEADER_END.search(data, at) if at >= 0 else None
        if not end:
            return
        h = _headers(data[at : end.start()])
        try:
            n = int(h["content-length"])
        except (KeyError, ValueError):
            at = end.end()
            continue
        block = data[end.end() : end.end() + n]
        if len(block) < n:
            return
        at = end.end() + n
        kind = h.get("warc-type", "")
        payload, length = block, None
        if kind in ("response", "revisit", "request") and "http" in h.get("content-type", ""):
            split = _HEADER_END.search(block)
            head, payload = (block[: split.start()], block[split.end() :]) if split else (block, b"")
            declared = _headers(head).get("content-length", "")
            length = int(declared) if declared.isdigit() else None
            block = head
        else:
            payload = None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" and payload is not None else None
        said = h.get("warc-payload-digest", "")
        yield (
            h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-date"),
            h.get("content-type"), said.partition(":")[2] or said or None, length, block, payload if kind == "response" else None, digest, len(payload) if digest else None,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _parse_datatype_string(RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse(content.as_py()):
                    rows.append(r)
                    held += len(r[9]) + len(r[10] or b"")
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(lean(run), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata that are concurrent to it.

    Without the column ``payload`` in ``records`` no payload moves.
    """
    main = records.where("record_type in ('response', 'revisit') and record_id is not null")
    side = records.where("record_type in ('request', 'metadata') and concurrent_to is not null")
    fields = ["record_id", "record_type", "date", "content_type", "block"]
    sides = side.groupBy(F.col("concurrent_to").alias("record_id")).agg(
        *(F.max(F.when(F.col("record_type") == k, F.struct(*fields))).alias(k) for k in ("request", "metadata"))
    )
    capture = main.select(
        "record_id",
        F.col("target").alias("url"),
        F.struct(*(c for c in records.columns if c not in ("concurrent_to", "target"))).alias("response"),
    )
    return capture.join(sides, "record_id", "left").select(F.col("record_id").alias("capture_id"), "url", "request", "response", "metadata")


def round_trip(pages: DataFrame, id_col="page_id", **options) -> DataFrame:
    """Writes and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok."""
    spark = pages.sparkSession
    path = write(pages, shared_path(spark, "warc"), id_col=id_col, **options)
    captures = assemble(read_records(spark, path).drop("payload"))
    number = lambda c: F.regexp_extract(c, "^<urn:capture:(-?[0-9]+):", 1).try_cast("long")
    r = F.col("response")
    return captures.select(
        F.regexp_extract(F.decode(F.col("metadata.block"), "utf-8"), "captureId: (-?[0-9]+)", 1).try_cast("long").alias(id_col),
        F.coalesce(r["payload_length"], r["http_length"]).alias("payload_bytes"),
        F.coalesce(r["payload_digest"], r["declared_digest"]).alias("payload_digest"),
        r["record_type"].alias("record_type"),
        F.when(r["record_type"] == "revisit", number(r["refers_to"])).alias("refers_to"),
    )


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
d AS (
  SELECT page_id, n, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS owner FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner = page_id THEN NULL ELSE owner END AS refers_to
FROM m
"""
