"""Tables laid out by a key aren't exchanged when they are joined by it, or by more."""

from __future__ import annotations

from factloom.plans import run_queries
from factloom.sources.shared import laid_out


def test_joins_by_the_key_or_more_do_not_move_laid_out_rows(spark):
    rows = spark.createDataFrame([(d, c, f"text {d} {c}") for d in range(9) for c in range(3)], "doc_id long, chunk_id int, text string")
    asked = laid_out(rows.selectExpr("doc_id", "chunk_id", "doc_id + chunk_id AS n"), "doc_id")
    texts = laid_out(rows, "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = asked.join(texts, ["doc_id", "chunk_id"]).groupBy("doc_id", "n").count()
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 27
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_conversion_of_entities_makes_no_relationships(spark, monkeypatch):
    monkeypatch.setattr(run_queries.convert, "with_evidence", lambda *a: 1 / 0)
    assert run_queries.r10(spark, "/root/testdata/sf0.001").columns == ["doc_id", "entity_id", "start_char", "end_char", "match"]
