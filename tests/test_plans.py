"""What plans must not hold, whatever the sizes of tables let Spark expect."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import chunk, metrics, similar
from factloom.plans import structure_queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_names_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("d", i, f"Aurora Machinery {i}") for i in range(20)], "scope string, id int, s string").write.parquet(f"{tmp_path}/names")
    rows = spark.read.parquet(f"{tmp_path}/names")  # a file's size is known and small, so a join of it would be a broadcast
    forms = rows.selectExpr("scope AS doc_id", "id", "array(s) AS forms")
    for df in (similar.self_candidates(rows), similar.candidates(rows, rows), metrics.name_pairs(forms, forms)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_joined_text_moves_a_row_a_document_once(spark):
    rows = spark.createDataFrame([("d", 1, 0, "c"), ("d", 0, 1, "b"), ("d", 0, 0, "a"), ("e", 3, 2, "x"), ("e", 12, 0, "y")], "doc_id string, sent int, pos int, token string")
    df = chunk.joined_text(rows.repartition(3))
    assert plan(df).count("Exchange hashpartitioning(doc_id") == 1 and "sent" not in "".join(x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x)
    assert dict(df.collect()) == {"d": "a b\nc\n", "e": "x\ny\n"}


def test_joined_text_of_documents_moves_nothing(spark, tmp_path):
    texts = [(1, "a b c d e f"), (2, ""), (3, None), (4, " a  b     "), (5, "     x"), (6, "     "), (7, "a b c d e      f")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = structure_queries.QUERIES["b04_joined_text"](spark, str(tmp_path))
    assert "Exchange" not in plan(df)
    expected = {1: "a b c d e\nf\n", 4: "a b\n", 5: "x\n", 7: "a b c d e\nf\n"}
    assert dict(df.collect()) == expected
    assert dict(chunk.joined_text(structure_queries._tokens(spark, str(tmp_path)).repartition(5)).collect()) == expected


def test_neighbours_of_a_sentence_are_joined_before_they_are_grouped(spark):
    rows = [("d", s, p, f"t{s}.{p}") for s in range(3) for p in range(4)] + [("e", 0, 3, None), ("e", 0, 0, "x"), ("e", 0, 1, "y")]
    df = spark.createDataFrame(rows, "doc_id string, sent int, pos int, token string").coalesce(1)
    assert "MapInArrow" in plan(chunk.joined_text(df))
    runs = df.select("doc_id", "sent", "pos", F.coalesce("token", F.lit("")).alias("token")).mapInArrow(chunk.joined_runs, df.schema).collect()
    assert [tuple(r) for r in runs] == [("d", s, 0, f"t{s}.0 t{s}.1 t{s}.2 t{s}.3") for s in range(3)] + [("e", 0, 3, ""), ("e", 0, 0, "x y")]
    expected = {"d": "".join(f"t{s}.0 t{s}.1 t{s}.2 t{s}.3\n" for s in range(3)), "e": "x y \n"}
    assert dict(chunk.joined_text(df).collect()) == expected and dict(chunk.joined_text(df.repartition(7)).collect()) == expected


def test_pieces_of_names_are_moved_as_numbers(spark):
    rows = spark.createDataFrame([("d", i, f"aurora building {i:03}") for i in range(40)] + [(None, 1, "aurora building 001")], "scope string, id int, s string")
    for df in (similar.candidates(rows, rows), similar.self_candidates(rows)):
        assert "SortMergeJoin [key#" in plan(df) and "seg#" not in plan(df)
    assert similar.candidates(rows, rows).where("scope IS NULL").count() == 0
    pairs = {(r.a, r.b) for r in similar.self_candidates(rows).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    same = spark.createDataFrame([("d", i, "aurora building") for i in range(9)], "scope string, id int, s string")
    assert similar.self_candidates(same).count() == 36 and similar.candidates(same, same).count() == 81
