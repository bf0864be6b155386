"""Normalization of source text as column expressions.

Comments are cut by one pass of a lexeme pattern whose quantifiers are possessive, so long
texts neither recurse nor backtrack.  Null texts give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text is a sequence of: strings, characters, line comments, block comments, other runs, a lone slash.
LEXEMES = (
    r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'
    r"|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)"
    r"|//[^\n]*+|/\*.*?(?:\*/|\z)"
    r"""|[^"'/]++|/"""
)


def remove_comments(source: Column) -> Column:
    """Without comments; strings and characters stay, newlines inside block comments stay."""
    pieces = F.regexp_extract_all(source, F.lit(LEXEMES), F.lit(0))
    bare = F.transform(
        pieces,
        lambda s: F.when(s.startswith("//"), "").when(s.startswith("/*"), F.regexp_replace(s, r"[^\n]", "")).otherwise(s),
    )
    return F.array_join(bare, "")


def normalize_whitespace(source: Column) -> Column:
    """No leading blanks or blank lines, runs of blanks as one, no newline at the end; a blank at a line's end stays."""
    one = F.regexp_replace(source, r"[ \t\r]+", " ")
    flush = F.regexp_replace(one, r"(^|\n) +", "$1")
    return F.regexp_replace(F.regexp_replace(flush, r"\n+", "\n"), r"^\n|\n\z", "")


def normalize_source(source: Column) -> Column:
    return normalize_whitespace(remove_comments(source))


def count_lines(source: Column) -> Column:
    """Newlines plus one; 0 for an empty text."""
    return F.when(source == "", 0).otherwise(F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit(""))) + 1).cast("long")


def count_tokens(source: Column) -> Column:
    """Words between blanks."""
    bare = F.regexp_replace(source, r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("long")


def count_chars(source: Column) -> Column:
    return F.length(source).cast("long")


def impact(raw: Column, normalized: Column) -> dict[str, Column]:
    """Lines, tokens and characters before and after normalization, and how many went."""
    measures = {"lines": count_lines, "tokens": count_tokens, "chars": count_chars}
    out = {}
    for name, measure in measures.items():
        out[f"original_{name}"] = measure(raw)
        out[f"normalized_{name}"] = measure(normalized)
        out[f"{name}_removed"] = F.greatest(measure(raw) - measure(normalized), F.lit(0).cast("long"))
    return out
