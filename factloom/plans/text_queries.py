"""Queries of the text functions (C) over spelling variants of names and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from . import inputs as I

QUERIES, ORACLE_SQL = {}, {}


def _words(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _names(name: str, expr, sql: str) -> None:
    QUERIES[name] = lambda spark, d: I.names(spark, d).select("k", expr().alias("v"))
    ORACLE_SQL[name] = f"WITH {I.NAMES} SELECT k, {sql} AS v FROM names"


def _texts(name: str, expr, sql: str) -> None:
    QUERIES[name] = lambda spark, d: I.texts(spark, d).select("doc_id", expr().alias("v"))
    ORACLE_SQL[name] = f"WITH {I.TEXTS} SELECT doc_id, {sql} AS v FROM texts"


_FOLD = "replace(lower({x}), 'ß', 'ss')"
PLAIN = r"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(trim({x})), '[.\-\s]+', ' ', 'g'), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN " + _words(S.SUFFIX_WORDS) + "), ' ')"
KEY = r"regexp_replace(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+', '', 'g')"
_TOKENS = r"list_filter(string_split_regex(regexp_replace(" + _FOLD + r", '\(.*?\)', ' ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
CORE = "array_to_string(CASE WHEN len(list_filter(" + _TOKENS + ", lambda w: w NOT IN " + _words(S.LENIENT_WORDS) + ")) > 0 THEN list_filter(" + _TOKENS + ", lambda w: w NOT IN " + _words(S.LENIENT_WORDS) + ") ELSE " + _TOKENS + " END, ' ')"
_ALIAS = r"regexp_replace(array_to_string(list_filter(string_split_regex(" + _FOLD + r", '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''), ' '), '^((the|der|die|das)( |$))+', '')"
ALIAS_KEY = "regexp_replace(" + _ALIAS + ", '( (" + "|".join([*S.LEGAL_FORMS, "und", "and"]) + "))+$', '')"
JUNK = r"(regexp_matches(trim({x}), '^(USD|\$|€|£)?\s*[\d,.]+$') OR regexp_matches({x}, '(?i)^(Section|Article|Clause)\s+\d+') OR regexp_matches(lower({x}), '(personnel|employees|staff|shareholders)$') OR " + PLAIN + " = '')"

_names("c01_normalize_entity_name", lambda: T.normalize_entity_name(F.col("name")), PLAIN.format(x="name"))
_texts("c02_norm_key", lambda: T.norm_key(F.col("t")), KEY.format(x="t"))
_names("c03_norm_name", lambda: T.norm_name(F.col("name")), KEY.format(x="name"))
_names("c04_core_name", lambda: T.core_name(F.col("name")), CORE.format(x="name"))
_names("c05_alias_tokens", lambda: F.array_join(T.alias_tokens(F.col("name")), " "), _ALIAS.format(x="name"))
_names("c06_alias_key", lambda: T.alias_key(F.col("name")), ALIAS_KEY.format(x="name"))
_names("c15_is_junk", lambda: T.is_junk(F.col("name")), JUNK.format(x="name"))
_names("c17_is_empty_after_normalization", lambda: T.normalize_entity_name(F.col("name")) == "", PLAIN.format(x="name") + " = ''")
_names("c27_has_legal_form", lambda: T.has_legal_form(F.col("name")), "list_has_any(string_split(" + _ALIAS.format(x="name") + ", ' '), [" + ", ".join(f"'{w}'" for w in S.LEGAL_FORMS) + "])")

_RAW_LABEL = "CASE k % 9 WHEN 0 THEN 'Org' WHEN 1 THEN ' PERSON ' WHEN 2 THEN 'Contract' WHEN 3 THEN 'subsidiary' WHEN 4 THEN 'misc' WHEN 5 THEN 'regulator' WHEN 6 THEN 'Asset' WHEN 7 THEN 'Firm' ELSE 'per' END"
_SYNONYMS = "CASE " + " ".join(f"WHEN lower(trim({_RAW_LABEL})) = '{w}' THEN '{t}'" for w, t in S.TYPE_SYNONYMS.items()) + " ELSE 'other' END"
_names("c08_norm_type", lambda: T.norm_type(F.expr(_RAW_LABEL)), _SYNONYMS)
_RAW_REL = "CASE k % 4 WHEN 0 THEN ' Transfers to' WHEN 1 THEN 'participates-in' WHEN 2 THEN 'Related - to ' ELSE 'controls' END"
_names("c09_norm_rel", lambda: T.norm_rel(F.expr(_RAW_REL)), rf"regexp_replace(lower(trim({_RAW_REL})), '[\s\-]+', '_', 'g')")
_names("c22_clean_id", lambda: T.clean_id(F.concat(F.lit(" [E"), F.col("k"), F.lit("] "))), "trim(trim(' [E' || k || '] '), '[]')")
_names("c24_recall_id", lambda: T.recall_id(F.col("name")), "'Recall_' || substring(md5(name), 1, 12)")
_names("c25_mask", lambda: T.mask(F.when(F.col("k") % 5 != 0, F.col("name"))), "CASE WHEN k % 5 <> 0 THEN '[redacted ' || length(name) || ' chars]' END")
_names("c23_is_placeholder", lambda: T.is_placeholder(F.expr("CASE k % 4 WHEN 0 THEN '#/texts/0' WHEN 1 THEN ' ' WHEN 2 THEN 'NA' ELSE name END")), r"regexp_matches(CASE k % 4 WHEN 0 THEN '#/texts/0' WHEN 1 THEN ' ' WHEN 2 THEN 'NA' ELSE name END, '^#/|^\s*$|^NA$')")
_names(
    "c12_entity_type",
    lambda: T.entity_type(F.expr("CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Company ' ELSE 'claim' END"), F.expr("CASE k % 3 WHEN 0 THEN 'OtherEntity' WHEN 1 THEN 'Person' ELSE NULL END")),
    "CASE k % 4 WHEN 2 THEN 'company' WHEN 3 THEN 'other' ELSE CASE k % 3 WHEN 1 THEN 'person' ELSE 'other' END END",
)
_CELL_S = "CASE k % 4 WHEN 0 THEN concat('[\"A', k, '\", \"\", \"A', k, '\", \"', name, '\"]') WHEN 1 THEN concat('plain ', k) WHEN 2 THEN ' ' ELSE NULL END"
_names("c13_cell_aliases", lambda: F.array_join(T.cell_aliases(F.expr(_CELL_S), F.col("name")), "|"), "CASE k % 4 WHEN 0 THEN 'A' || k WHEN 1 THEN 'plain ' || k ELSE '' END")
_names(
    "c14_repair_run",
    lambda: F.concat_ws("/", F.regexp_replace(F.lower(F.expr("CASE WHEN k % 2 = 0 THEN 'OtherEntity' ELSE upper(type) END")), "^otherentity$", "other"), F.array_join(F.filter(F.array(F.lit(None).cast("string"), F.lit(""), F.col("name")), lambda a: a.isNotNull() & (T.strip(a) != "")), "|")),
    "CASE WHEN k % 2 = 0 THEN 'other' ELSE type END || '/' || name",
)
_names(
    "c16_is_acronym",
    lambda: T.is_acronym(F.expr("CASE WHEN k % 2 = 0 THEN 'fda' ELSE 'FADA' END"), F.lit("Food and Drug Administration")),
    "k % 2 = 0",
)
_names(
    "c21_surface_forms",
    lambda: F.array_join(T.surface_forms(F.col("name"), F.array(F.lower("name"), F.lit(" ")), F.array(F.col("name"), F.lit("M"))), "|"),
    "CASE WHEN lower(name) = name THEN name || '|M' ELSE name || '|' || lower(name) || '|M' END",
)
_names(
    "c26_meta_strings",
    lambda: F.array_join(F.array_sort(F.map_values(T.meta_strings(F.create_map(F.lit("a"), F.repeat("name", 20), F.lit("b"), F.lit(None).cast("string"))))), "|"),
    "substring(repeat(name, 20), 1, 190)",
)
_names("c29_citation_label", lambda: T.citation_label(F.expr("CASE k % 4 WHEN 0 THEN 'verbatim' WHEN 1 THEN 'name_search' WHEN 2 THEN 'cooccurrence' END")), "CASE k % 4 WHEN 0 THEN 'Verbatim quote' WHEN 1 THEN 'Name search' WHEN 2 THEN 'Co-occurrence' ELSE 'Unanchored' END")
_names("b05_detok", lambda: T.detok(F.concat(F.lit("( "), F.col("name"), F.lit(" ) Inc . , x ;"))), r"regexp_replace(regexp_replace('( ' || name || ' ) Inc . , x ;', '\(\s+', '(', 'g'), '\s+([,.;:)])', '\1', 'g')")
QUERIES["c28_document_format"] = lambda spark, d: I.table(spark, d, "pages").select(F.col("page_id").alias("k"), T.document_format(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("# Title\nx")).alias("v")).union(I.texts(spark, d).select("doc_id", T.document_format(F.col("t"))))
ORACLE_SQL["c28_document_format"] = rf"WITH {I.TEXTS} SELECT page_id AS k, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'markdown' END AS v FROM pages UNION ALL SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)<(html|body|div|p|table|h[1-6])[\s>]') THEN 'html' WHEN regexp_matches(t, '(?m)^(#{{1,6}} |\| |[-*] )') THEN 'markdown' ELSE 'text' END FROM texts"


_CARD = "CASE {t} WHEN 'person' THEN 'PER' WHEN 'company' THEN 'ORG' WHEN 'agreement' THEN 'LAW' WHEN 'asset' THEN 'DATE' ELSE 'XYZ' END"


def c10_map_type(spark, d):
    """A card's map: PER and ORG are mapped, LAW is mapped to null (dropped), labels it doesn't name go too."""
    card = spark.createDataFrame([("per", "person"), ("org", "company"), ("law", None)], "label string, to string")
    rows = I.names(spark, d).select("k", F.lower(F.expr(_CARD.format(t="type"))).alias("label"))
    return rows.join(F.broadcast(card), "label").where("to is not null").select("k", F.col("to").alias("v"))


QUERIES["c10_map_type"] = c10_map_type
ORACLE_SQL["c10_map_type"] = f"WITH {I.NAMES} SELECT k, type AS v FROM names WHERE type IN ('person', 'company')"


def c11_map_relation(spark, d):
    """Rename with optional flip of direction; null drops."""
    card = spark.createDataFrame([("controls", "controls", False), ("governs", "controls", True), ("owns", None, False)], "relation string, to string, flip boolean")
    rows = I.edges(spark, d).join(F.broadcast(card), "relation").where("to is not null")
    return rows.select("pos", F.col("to").alias("relation"), F.when(F.col("flip"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("flip"), F.col("source")).otherwise(F.col("target")).alias("target"))


QUERIES["c11_map_relation"] = c11_map_relation
ORACLE_SQL["c11_map_relation"] = f"WITH {I.NAMES}, {I.EDGES} SELECT pos, 'controls' AS relation, CASE WHEN relation = 'governs' THEN target ELSE source END AS source, CASE WHEN relation = 'governs' THEN source ELSE target END AS target FROM edges WHERE relation IN ('controls', 'governs')"


def b09_snippet(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), (F.col("doc_id") % 200).cast("int"), (F.col("doc_id") % 200 + 10).cast("int")).alias("v"))
    return rows


QUERIES["b09_snippet"] = b09_snippet
ORACLE_SQL["b09_snippet"] = """SELECT doc_id, CASE WHEN doc_id % 200 > 45 THEN '…' ELSE '' END || substring(text, greatest(doc_id % 200 - 45, 0) + 1, least(doc_id % 200 + 55, length(text)) - greatest(doc_id % 200 - 45, 0))
 || CASE WHEN doc_id % 200 + 55 < length(text) THEN '…' ELSE '' END AS v FROM documents"""
