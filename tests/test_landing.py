"""Uploads, archives and fetch locks on small files."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.sources import landing


def _files(spark, rows):
    return spark.createDataFrame(rows, "filename string, content string, at long").select("filename", "content", F.timestamp_seconds("at").alias("uploaded_at"))


def test_landing_twice_leaves_one_file(spark, tmp_path):
    path = f"file://{tmp_path}/up"
    rows = _files(spark, [("my_own_file.txt", "hello", 10), ("scan.pdf", None, 30), ("x.TXT", "loud", 20), (None, "n", 20)])
    landing.land(rows, path, buckets=4)
    landing.land(rows, path, buckets=4)
    landing.land(_files(spark, [("my_own_file.txt", "other", 40)]), path)
    listed = landing.listing(spark, path).collect()
    assert [r.filename for r in listed][:2] == ["my_own_file.txt", "scan.pdf"] and len(listed) == 5
    assert {(r.filename, r.size_bytes) for r in listed} == {("my_own_file.txt", 5), ("scan.pdf", 0), ("x.TXT", 4), ("", 1)}
    assert all(r.stored_filename == f"{r.upload_id}_{r.filename}" and len(r.upload_id) == 8 for r in listed)


def test_views(spark, tmp_path):
    path = f"file://{tmp_path}/up"
    landing.land(_files(spark, [("a.txt", "text", 1), ("b.pdf", "%PDF", 1), ("c.TXT", "loud", 1), ("plain", "p", 1)]), path, buckets=2)
    ids = {r.filename: r.upload_id for r in landing.listing(spark, path).collect()}
    asked = spark.createDataFrame([(ids["a.txt"],), (ids["a.txt"],), (ids["b.pdf"],), (ids["c.TXT"],), (ids["plain"],), ("none",), (None,)], "upload_id string")
    got = sorted(((r.status, r.type or "", r.content or "") for r in landing.views(asked, spark, path).collect()))
    assert got == [(200, "pdf", ""), (200, "text", "text"), (200, "text", "text"), (400, "", ""), (400, "", ""), (404, "", ""), (404, "", "")]


@pytest.mark.parametrize(("name", "path"), [("a/b.txt", "a/b.txt"), ("a/../b", "b"), ("../b", None), ("a/../../b", None), ("/etc/x", None), ("..", None), ("..b/c", "..b/c"), ("a\\..\\..\\b", None)])
def test_inside(name, path):
    assert landing.inside(name) == path


def _zip(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "" if n.endswith("/") else f"<{n}>")
    return out.getvalue()


def test_members_include_and_strip(spark):
    rows = spark.createDataFrame([("z", bytearray(_zip(["top/", "top/a.txt", "top/d/b.txt", "top/c.csv", "e.txt"]))), ("none", None)], "archive string, content binary")
    got = {r.path: bytes(r.content).decode() for r in landing.unpack(rows, include=("*.txt",), strip=1).collect()}
    assert got == {"a.txt": "<top/a.txt>", "d/b.txt": "<top/d/b.txt>", "e.txt": "<e.txt>"}
    assert landing.members(rows.where("archive = 'none'")).count() == 0


def test_unsafe_member_fails_the_job(spark):
    rows = spark.createDataFrame([("z", bytearray(_zip(["ok.txt", "../out.txt"])))], "archive string, content binary")
    assert {r.member: r.path for r in landing.members(rows).collect()} == {"ok.txt": "ok.txt", "../out.txt": None}
    with pytest.raises(PySparkException, match="unsafe path in archive"):
        landing.unpack(rows).collect()


def test_zip_round_trip_in_parts(spark):
    rows = spark.createDataFrame([(f"f{i}.txt", "é" * i if i else None) for i in range(11)], "member string, content string").coalesce(1)
    zips = landing.zipped(rows, most=4)
    assert zips.count() == 3
    assert {r.path: bytes(r.content).decode() for r in landing.unpack(zips).collect()} == {f"f{i}.txt": "é" * i for i in range(11)}


def test_lock_tells_changes(spark, tmp_path):
    schema = "url string, content string"
    landing.write_lock(spark.createDataFrame([("same", "1"), ("edited", "2"), ("gone", "3")], schema), f"file://{tmp_path}/lock")
    now = spark.createDataFrame([("same", "1"), ("edited", "two"), ("new", "4")], schema)
    assert {tuple(r) for r in landing.changed(now, landing.read_lock(spark, f"file://{tmp_path}/lock")).collect()} == {("edited", "changed"), ("gone", "gone"), ("new", "new")}
