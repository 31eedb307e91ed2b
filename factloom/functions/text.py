"""Name, type and text functions as Column expressions.

Several name keys exist side by side because different stages compare differently; see each docstring.  White space means
Unicode white space, letters and digits are Unicode categories L and N.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schema as S

SPACE = "(?U)\\s+"
NON_WORD = "[^\\p{L}\\p{N}]+"


def _lit_array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def strip(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, "^(?U)\\s+|(?U)\\s+$", "")


def squeeze(s: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(s, SPACE, " ")


def casefold(s: Column) -> Column:
    """Lower case, with sharp s as ss: case folding of the Latin letters that occur in names."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


def words_without(s: Column, dropped: list[str], separator: str) -> Column:
    """Non-empty parts of ``s`` that aren't in ``dropped``."""
    return F.filter(F.split(s, separator), lambda w: (w != "") & ~w.isin(dropped))


def normalize_entity_name(name: Column) -> Column:
    """Lower case, dots, hyphens and blanks as one blank, no ASCII punctuation, no company suffix words."""
    s = F.regexp_replace(strip(F.lower(name)), "(?U)[.\\-\\s]+", " ")
    s = F.regexp_replace(s, "[!-/:-@\\[-`{-~]", "")
    return F.array_join(words_without(s, S.SUFFIX_WORDS, SPACE), " ")


def norm_key(s: Column) -> Column:
    """Case-folded letters and digits; null as empty."""
    return F.regexp_replace(casefold(F.coalesce(s, F.lit(""))), NON_WORD, "")


@F.pandas_udf(StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def fold(s: Column) -> Column:
    """Compatibility composition and case folding.  Pure ASCII stays in the JVM; the rest needs Python's tables."""
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike("^[\\x00-\\x7F]*$"), F.lower(s)).otherwise(_fold_udf(F.when(~s.rlike("^[\\x00-\\x7F]*$"), s)))


def norm_name(s: Column) -> Column:
    """Strict evaluation key: folded letters and digits."""
    return F.regexp_replace(fold(s), NON_WORD, "")


def core_tokens(s: Column) -> Column:
    """Folded words without parentheses and legal words; all words where nothing else is left."""
    tokens = F.filter(F.split(F.regexp_replace(fold(s), "\\(.*?\\)", " "), NON_WORD), lambda w: w != "")
    core = F.filter(tokens, lambda w: ~w.isin(S.LENIENT_WORDS))
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def core_name(s: Column) -> Column:
    return F.array_join(core_tokens(s), " ")


def alias_tokens(s: Column) -> Column:
    """Case-folded words without leading articles; "e. V." is one word."""
    joined = F.regexp_replace(F.coalesce(s, F.lit("")), "(?i)\\be\\.\\s?v\\b\\.?", "ev")
    tokens = F.filter(F.split(casefold(joined), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")

    def own(ts: Column) -> Column:  # the words are a lambda's argument, so that they are made once
        articles = F.aggregate(ts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + F.when(a["on"] & w.isin(S.ARTICLES), 1).otherwise(0)).alias("n"), (a["on"] & w.isin(S.ARTICLES)).alias("on")))["n"]
        return F.slice(ts, articles + 1, F.greatest(F.size(ts) - articles, F.lit(0)))

    return F.element_at(F.transform(F.array(tokens), own), 1)


def alias_key(s: Column) -> Column:
    """Words without trailing legal forms and connectives, but never without any word."""
    return _key_of(alias_tokens(s))


def _key_of(tokens: Column) -> Column:
    tail = "|".join([*S.LEGAL_FORMS, "und", "and"])
    return F.regexp_replace(F.array_join(tokens, " "), f"( (?:{tail}))+$", "")


def _has_legal_word(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, _lit_array(S.LEGAL_FORMS))


def has_legal_form(s: Column) -> Column:
    return _has_legal_word(alias_tokens(s))


def name_keys(s: Column) -> Column:
    """A struct of a form's alias and norm keys and whether it has a legal form; its words are made once."""
    return F.element_at(F.transform(F.array(alias_tokens(s)), lambda ts: F.struct(_key_of(ts).alias("alias"), norm_key(s).alias("norm"), _has_legal_word(ts).alias("legal"))), 1)


def norm_type(label: Column, extra: dict[str, str] | None = None) -> Column:
    """Ontology type of a free-form label; the card's own map first, "other" if unknown."""
    key = strip(fold(label))
    table = S.TYPE_SYNONYMS | (extra or {})
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit("other"))


def norm_rel(label: Column) -> Column:
    return F.regexp_replace(strip(fold(label)), "(?U)[\\s\\-]+", "_")


def entity_type(declared: Column, label: Column) -> Column:
    """Type of a graph node: its declared type or else its label, by class name; unknown ones are "other"."""
    raw = F.lower(strip(F.coalesce(F.nullif(declared, F.lit("")), F.nullif(label, F.lit("")), F.lit("other"))))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in S.CLASS_TYPES.items() for x in kv)), raw), F.lit("other"))


def cell_aliases(cell: Column, name: Column) -> Column:
    """Aliases in a cell: a JSON list, or else the text itself; distinct, without blanks and the name."""
    listed = F.when(strip(cell) == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(cell, "array<string>"), F.array(cell)))
    return F.coalesce(F.filter(F.array_distinct(listed), lambda a: a.isNotNull() & (strip(a) != "") & (a != name)), F.array().cast("array<string>"))


def is_junk(name: Column) -> Column:
    """Amounts and numbers, clause references, staff plurals, and names of suffix words only."""
    return (
        strip(name).rlike("^(USD|\\$|€|£)?\\s*[\\d,.]+$")
        | name.rlike("(?i)^(Section|Article|Clause)\\s+\\d+")
        | F.lower(name).rlike("(personnel|employees|staff|shareholders)$")
        | (normalize_entity_name(name) == "")
    )


def is_acronym(short: Column, long: Column) -> Column:
    words = F.filter(F.split(long, SPACE), lambda w: (w != "") & ~F.lower(w).isin("and", "of", "the", "for"))
    initials = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.char_length(short).between(2, 6) & (F.upper(short) == initials)


def surface_forms(name: Column, aliases: Column, mentions: Column) -> Column:
    """Name, aliases and mention texts in order, distinct, without blanks."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.array(name), F.coalesce(aliases, none), F.coalesce(mentions, none)), lambda x: x.isNotNull() & (strip(x) != "")))


def clean_id(s: Column) -> Column:
    return F.regexp_replace(strip(s.cast("string")), "^[\\[\\]]+|[\\[\\]]+$", "")


def is_placeholder(quote: Column) -> Column:
    return quote.rlike("^#/|^\\s*$|^NA$")


def recall_id(name: Column) -> Column:
    return F.concat(F.lit("Recall_"), F.substring(F.md5(F.encode(name, "utf-8")), 1, 12))


def mask(s: Column) -> Column:
    return F.when(s.isNotNull(), F.concat(F.lit("[redacted "), F.char_length(s).cast("string"), F.lit(" chars]")))


def mask_struct(df, columns: list[str]):
    """Masks strings, arrays of strings and string maps of the named columns."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] == "string":
            df = df.withColumn(c, mask(F.col(c)))
        elif kinds[c] == "array<string>":
            df = df.withColumn(c, F.transform(c, mask))
        elif kinds[c] == "map<string,string>":
            df = df.withColumn(c, F.transform_values(c, lambda _, v: mask(v)))
    return df


def meta_strings(meta: Column) -> Column:
    """A map's values cut at 190 characters; nulls go."""
    return F.transform_values(F.map_filter(meta, lambda _, v: v.isNotNull()), lambda _, v: F.substring(v, 1, 190))


def document_format(text: Column) -> Column:
    """html, markdown or text, by their marks."""
    return F.when(text.rlike("(?i)<(html|body|div|p|table|h[1-6])[\\s>]"), "html").when(text.rlike("(?m)^(#{1,6} |\\| |[-*] )"), "markdown").otherwise("text")


def citation_label(match: Column) -> Column:
    return F.when(match == "verbatim", "Verbatim quote").when(match == "name_search", "Name search").when(match == "cooccurrence", "Co-occurrence").otherwise("Unanchored")


def detok(s: Column) -> Column:
    """Spaces inside brackets and before closing punctuation go."""
    return F.regexp_replace(F.regexp_replace(s, "(?U)\\(\\s+", "("), "(?U)\\s+([,.;:)])", "$1")


def snippet(text: Column, start: Column, end: Column, around: int = 45) -> Column:
    """The span with ``around`` characters on each side and ellipses where text was cut."""
    lo, hi = F.greatest(start - around, F.lit(0)), F.least(end + around, F.char_length(text))
    body = F.substring(text, lo + 1, hi - lo)
    return F.concat(F.when(lo > 0, "…").otherwise(""), body, F.when(hi < F.char_length(text), "…").otherwise(""))
