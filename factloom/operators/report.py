"""Evaluation reports as a table of numbered lines, in order and always the same for the same rows.

Every section is a frame of (section, n, line) that Spark builds from the metric tables; their lines are few, whatever the
number of documents: sums, and the weakest documents with the beginnings of their error lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import store
from . import metrics as M

NONE = "n/a"
COUNTS = ("tp", "fp", "fn")


def percent(value: Column) -> Column:
    """One decimal; null is n/a, never 0."""
    return F.when(value.isNull(), NONE).otherwise(F.format_string("%.1f%%", (value * 100).cast("double")))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NONE))


def lines(rows: DataFrame, section: int, order: list[Column | str], line: Column) -> DataFrame:
    """(section, n, line) of few rows, numbered from 100 so that headings come before."""
    n = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order)) + 99
    return rows.select(F.lit(section).alias("section"), n.alias("n"), line.alias("line"))


def heading(like: DataFrame, section: int, *texts: str) -> DataFrame:
    return like.sparkSession.createDataFrame([(section, i, t) for i, t in enumerate(texts)], "section int, n int, line string")


def table(rows: DataFrame, section: int, title: str, columns: dict[str, Column], order: list[Column | str], note: str = "") -> DataFrame:
    """A section with a Markdown table."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *columns.values()), F.lit(" |"))
    head = [f"## {title}", "", *([note, ""] if note else []), "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return heading(rows, section, "", *head).unionByName(lines(rows, section, order, cells))


def _scores(counts: DataFrame, label: str, n: int) -> DataFrame:
    """label, sums, rates and the interval of f1 of per-document counts."""
    counts = counts if "precise" in counts.columns else counts.withColumn("precise", F.lit(True))
    ends = M.bootstrap(counts, n).where("metric = 'f1'").select("lo", "hi")
    return M.summarise(counts).withColumn("label", F.lit(label)).join(ends, how="left")


def _rates() -> dict[str, Column]:
    f1 = F.concat(percent(F.col("f1")), F.when(F.col("lo").isNotNull(), F.concat(F.lit(" ["), percent(F.col("lo")), F.lit(", "), percent(F.col("hi")), F.lit("]"))).otherwise(""))
    return {"P": percent(F.col("precision")), "R": percent(F.col("recall")), "F1 (95% CI)": f1} | {c.upper(): number(F.col(c)) for c in COUNTS}


def _ranked(rows: DataFrame, section: int, title: str, key: str) -> DataFrame:
    """One line of (key, n) pairs, the most frequent first."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))), lambda x: F.concat_ws(" ", x["k"], (-x["m"]).cast("string")))
    said = F.when(F.size(pairs) > 0, F.array_join(pairs, ", ")).otherwise("none")
    return lines(rows.groupBy().agg(said.alias("s")), section, ["s"], F.concat(F.lit(f"{title}: "), F.col("s")))


def _weakest(gold: DataFrame, pred: DataFrame, aligned: DataFrame, counts: DataFrame, section: int, documents: int, names: int) -> DataFrame:
    f1 = F.when(F.col("precise"), F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
    worst = store(counts.select("doc_id", f1.alias("f1")).orderBy(F.asc_nulls_last("f1"), "doc_id").limit(documents))

    def errors(rows: DataFrame, end: str, to: str) -> DataFrame:
        left = rows.join(worst.select("doc_id"), "doc_id", "left_semi").join(aligned.select("doc_id", F.col(end).alias("id")), ["doc_id", "id"], "left_anti")
        return left.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, names), "; ").alias(to))

    rows = worst.join(errors(gold, "gold_id", "missed"), "doc_id", "left").join(errors(pred, "pred_id", "extra"), "doc_id", "left")
    cells = {"document": F.col("doc_id").cast("string"), "F1": percent(F.col("f1")), "missed": F.coalesce("missed", F.lit("")), "extra": F.coalesce("extra", F.lit(""))}
    return table(rows, section, "Weakest documents", cells, [F.asc_nulls_last("f1"), "doc_id"], "By lenient F1 of entities; the first names of each list.")


def report(title: str, gold: DataFrame, pred: DataFrame, docs: DataFrame, gold_relations: DataFrame, pred_relations: DataFrame, scope: DataFrame | None = None, replicates: int = 1000, documents: int = 5, names: int = 5) -> DataFrame:
    """(section, n, line) of a whole evaluation.

    ``gold`` and ``pred`` have (doc_id, id, name, type, aliases, forms), the relations (doc_id, source, relation, target) in ids of
    their own side, ``docs`` (doc_id, text).  Documents without predictions count as missed.
    """
    aligned = store(M.align(M.similarities(gold, pred)))
    counts = {mode: store(M.entity_counts(gold, pred, aligned, mode == "strict", scope)) for mode in ("strict", "lenient")}
    entities = reduce(DataFrame.unionByName, (_scores(c, mode, replicates) for mode, c in counts.items()))
    mapped = store(M.mapped_relations(pred_relations, aligned))
    found = store(aligned.select("doc_id", F.col("gold_id").alias("id")))
    ends = lambda c: found.withColumnRenamed("id", c)
    reachable = gold_relations.join(ends("source"), ["doc_id", "source"], "left_semi").join(ends("target"), ["doc_id", "target"], "left_semi")
    resolved = mapped.where("not startswith(source, '?') and not startswith(target, '?')")
    relations = []
    for i, level in enumerate(M.LEVELS):
        given = M.summarise(M.relation_counts(reachable, resolved, level).withColumn("precise", F.lit(True))).select(F.col("f1").alias("conditional"))
        relations.append(_scores(M.relation_counts(gold_relations, mapped, level), level, replicates).join(given).withColumn("i", F.lit(i)))
    confusion = store(M.typing_confusion(gold, pred, aligned))
    typing = confusion.agg(F.try_divide(F.sum(F.when(F.col("gold_type") == F.col("pred_type"), F.col("n")).otherwise(0)), F.sum("n")).alias("typing"))
    aliases = M.alias_recall(gold, pred, aligned).select(F.try_divide("covered", "total").alias("aliases"))
    classes = store(M.diagnose(gold, pred, aligned, docs))
    by_class = lambda side: classes.where(F.col("side") == side).groupBy("class").agg(F.sum("n").alias("n"))
    varied = M.sensitivity(gold, pred, aligned).select("variant", *COUNTS, *M.prf(F.col("tp"), F.col("fp"), F.col("fn")))
    total = gold.select("doc_id").union(pred.select("doc_id")).distinct().groupBy().agg(F.count(F.lit(1)).alias("n"))
    missing = gold.select("doc_id").distinct().join(pred.select("doc_id"), "doc_id", "left_anti").groupBy().agg(F.count(F.lit(1)).alias("missing"))
    parts = [
        heading(gold, 0, f"# Evaluation: {title}", ""),
        lines(total.join(missing), 0, ["n"], F.concat(F.lit("Documents: "), F.col("n"), F.lit("; without prediction, scored as all missed: "), F.col("missing"))),
        table(entities, 1, "Entities", {"mode": F.col("label")} | _rates() | {"macro F1": percent(F.col("macro_f1"))}, [F.desc("label")]),
        heading(gold, 2, ""),
        lines(typing.join(aliases), 2, ["typing"], F.concat(F.lit("Types right on aligned entities: "), percent(F.col("typing")), F.lit("; alias recall: "), percent(F.col("aliases")))),
        heading(gold, 3, ""),
        _ranked(confusion.where("gold_type <> pred_type").select(F.concat_ws(" as ", "gold_type", "pred_type").alias("k"), "n"), 3, "Confused types", "k"),
        table(reduce(DataFrame.unionByName, relations), 4, "Relations", {"level": F.col("label")} | _rates() | {"F1, both ends found": percent(F.col("conditional"))}, ["i"]),
        heading(gold, 5, "", "## Errors", ""),
        _ranked(by_class("missed"), 5, "Missed", "class"),
        _ranked(by_class("extra"), 6, "Surplus", "class"),
        table(varied, 7, "Sensitivity", {"variant": F.col("variant"), "P": percent(F.col("precision")), "R": percent(F.col("recall")), "F1": percent(F.col("f1"))} | {c.upper(): number(F.col(c)) for c in COUNTS}, [F.col("variant") != "baseline", "variant"], "Filters after matching, for diagnosis; the baseline is the score."),
        _weakest(gold, pred, aligned, counts["lenient"], 8, documents, names),
    ]
    return reduce(DataFrame.unionByName, parts)


def text_of(report_lines: DataFrame) -> str:
    """The report as one text; it has a few dozen lines."""
    return "\n".join(r["line"] for r in report_lines.orderBy("section", "n").collect()) + "\n"


def write_report(report_lines: DataFrame, path: str) -> None:
    """report.md's lines in order as one text file, through Spark's writer."""
    report_lines.orderBy("section", "n").coalesce(1).select("line").write.mode("overwrite").text(path)
