"""The report of a small evaluation against its golden text, worked out by hand."""

from __future__ import annotations

from factloom.operators import report

ENT = "doc_id string, id string, name string, type string, aliases array<string>, forms array<string>"
REL = "doc_id string, source string, relation string, target string"

#: d1: Acme and Carol are found, Carol with the wrong type; Bolt is missed, Echo is in no text.  d2 has no prediction.
GOLDEN = """# Evaluation: small

Documents: 2; without prediction, scored as all missed: 1

## Entities

| mode | P | R | F1 (95% CI) | TP | FP | FN | macro F1 |
| --- | --- | --- | --- | --- | --- | --- | --- |
| strict | 33.3% | 25.0% | 28.6% [0.0%, 33.3%] | 1 | 2 | 3 | 16.7% |
| lenient | 66.7% | 50.0% | 57.1% [0.0%, 66.7%] | 2 | 1 | 2 | 33.3% |

Types right on aligned entities: 50.0%; alias recall: 100.0%

Confused types: person as company 1

## Relations

| level | P | R | F1 (95% CI) | TP | FP | FN | F1, both ends found |
| --- | --- | --- | --- | --- | --- | --- | --- |
| strict | 0.0% | 0.0% | 0.0% | 0 | 2 | 2 | 0.0% |
| undirected | 50.0% | 50.0% | 50.0% | 1 | 1 | 1 | 100.0% |
| untyped | 0.0% | 0.0% | 0.0% | 0 | 2 | 2 | 0.0% |
| pair | 50.0% | 50.0% | 50.0% | 1 | 1 | 1 | 100.0% |

## Errors

Missed: absent 2
Surplus: unsupported 1

## Sensitivity

Filters after matching, for diagnosis; the baseline is the score.

| variant | P | R | F1 | TP | FP | FN |
| --- | --- | --- | --- | --- | --- | --- |
| baseline | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |
| all_filters_combined (ceiling) | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |
| drop_anonymised | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |
| drop_descriptive | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |
| drop_reference_like | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |
| person_company_only | 66.7% | 50.0% | 57.1% | 2 | 1 | 2 |

## Weakest documents

By lenient F1 of entities; the first names of each list.

| document | F1 | missed | extra |
| --- | --- | --- | --- |
| d2 | 0.0% | Delta AG |  |
| d1 | 66.7% | Bolt LLC | Echo Inc |
"""


def _tables(spark, parts):
    gold = [("d1", "g1", "Acme Corp", "company", ["ACM"]), ("d1", "g2", "Bolt LLC", "company", []), ("d1", "g3", "Carol Diaz", "person", []), ("d2", "g1", "Delta AG", "company", [])]
    pred = [("d1", "p1", "Acme Corporation", "company", ["ACM"]), ("d1", "p2", "Carol Diaz", "company", []), ("d1", "p3", "Echo Inc", "company", [])]
    ents = lambda rows: spark.createDataFrame([(*r, [r[2], *r[4]]) for r in rows], ENT).repartition(parts)
    rels = lambda rows: spark.createDataFrame(rows, REL).repartition(parts)
    docs = spark.createDataFrame([("d1", "Acme Corp and Bolt LLC met Carol Diaz."), ("d2", "Delta AG")], "doc_id string, text string")
    return ents(gold), ents(pred), docs, rels([("d1", "g1", "controls", "g3"), ("d1", "g1", "controls", "g2")]), rels([("d1", "p2", "controls", "p1"), ("d1", "p1", "controls", "p3")])


def test_report_equals_the_golden_text(spark, tmp_path):
    made = report.report("small", *_tables(spark, 1), replicates=50)
    assert report.text_of(made) == GOLDEN
    report.write_report(report.report("small", *_tables(spark, 3), replicates=50), f"file://{tmp_path}/report.md")
    assert "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/report.md").collect()) + "\n" == GOLDEN
