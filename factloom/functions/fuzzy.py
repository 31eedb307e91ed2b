"""Similarity of names by longest common subsequence.

The ratio of two strings is 2 * LCS / (sum of lengths).  It can reach r only if the shorter length is at least
r / (2 - r) of the longer, so joins first compare lengths; nothing is lost by that.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one big integer as a row of bits."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * lcs(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """0 to 100."""
    return _ratio_udf(a, b)


def lengths_allow(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone leave a ratio of ``least`` (0 to 1) possible."""
    return 2.0 * F.least(F.char_length(a), F.char_length(b)) >= least * (F.char_length(a) + F.char_length(b))


def token_sorted(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(s, T.SPACE), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(token_sorted(a), token_sorted(b))


def name_similarity(strict_a: Column, strict_b: Column, core_a: Column, core_b: Column, least: float = 0.9, fuzzy: bool = True) -> Column:
    """1 for equal strict keys, 0.97 for equal core names, else the core names' ratio where it reaches ``least``, else 0.

    Empty strict keys equal nothing.
    """
    possible = (core_a != "") & (core_b != "") & lengths_allow(core_a, core_b, least) & F.lit(fuzzy)
    r = ratio(F.when(possible, core_a), F.when(possible, core_b)) / 100
    return F.when((strict_a == strict_b) & (strict_a != ""), 1.0).when((core_a == core_b) & (core_a != ""), 0.97).when(r >= least, r).otherwise(0.0)
