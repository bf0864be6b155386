"""Similarities of two token sequences or count vectors, and the feature expressions of a pair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import tokens as T

#: Tokens of either side that the longest common subsequence looks at.
LCS_TOKENS = 512


def _empties(a: Column, b: Column, value: Column, both: float = 1.0) -> Column:
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, both).when(none_a | none_b, 0.0).otherwise(value)


def jaccard(a: Column, b: Column, both: float = 1.0) -> Column:
    return _empties(a, b, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), both)


def dice(a: Column, b: Column) -> Column:
    return _empties(a, b, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def spelled(tokens: Column) -> Column:
    """Categories as decimal numbers with blanks between."""
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), " ")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty strings."""
    return F.coalesce(1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(1.0))


def char_jaccard(a: Column, b: Column) -> Column:
    some = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return jaccard(some(a), some(b), both=0.0)


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 if the larger is 0."""
    return F.coalesce(F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def bigram_overlap(a: Column, b: Column) -> Column:
    """Elements of a, with their repeats, that b holds, over the rest of both; may pass 1 and is not symmetric."""
    hits = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(hits / (F.size(a) + F.size(b) - hits))


def identifier_ratio(a: Column, b: Column) -> Column:
    own = lambda x: F.size(F.filter(x, lambda t: t == T.IDENTIFIER))
    return F.coalesce(2.0 * F.least(own(a), own(b)) / F.nullif(own(a) + own(b), F.lit(0)), F.lit(1.0))


def lcs_length(a, b, most: int | None = LCS_TOKENS) -> int:
    """Length of the longest common subsequence of the first ``most`` tokens (null: of all), a bit per token of a."""
    a, b = a[:most], b[:most]
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _ratios(a: pd.Series, b: pd.Series, most: int | None) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x), list(y)
        out.append(1.0 if not x and not y else 2.0 * lcs_length(x, y, most) / (len(x) + len(y)))
    return pd.Series(out, dtype=float)


def _first_lcs_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(a, b, LCS_TOKENS)


def _whole_lcs_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(a, b, None)


def lcs_ratio(a: str, b: str, whole: bool = False) -> Column:
    """Twice the common length, of at most ``LCS_TOKENS`` of each side unless ``whole``, over both whole lengths."""
    return F.pandas_udf(_whole_lcs_ratios if whole else _first_lcs_ratios, DoubleType())(a, b)
