"""Normalization and token statistics of a corpus (``id, text``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T


def normalized(corpus: DataFrame) -> DataFrame:
    """With ``norm_text``."""
    return corpus.withColumn("norm_text", X.normalize_source(F.col("text")))


def impact(corpus: DataFrame) -> DataFrame:
    """A row per snippet: lines, tokens and characters before and after normalization."""
    return normalized(corpus).select("id", *(c.alias(k) for k, c in X.impact(F.col("text"), F.col("norm_text")).items()))


def impact_summary(rows: DataFrame) -> DataFrame:
    """Means of all measures, sums of what went, and the number of snippets."""
    measures = [c for c in rows.columns if c != "id"]
    return rows.agg(
        *(F.round(F.avg(c), 6).alias(f"avg_{c}") for c in measures),
        *(F.sum(c).alias(f"total_{c}") for c in ("lines_removed", "tokens_removed")),
        F.count("*").alias("snippets"),
    )


def length_stats(corpus: DataFrame, group: str) -> DataFrame:
    """Mean, deviation, extremes and median of lines, tokens and characters per group.

    One pass: an exact median keeps a count per distinct value, and lengths have few of those.
    """
    own = corpus.select(group, X.count_lines(F.col("text")).alias("lines"), X.count_tokens(F.col("text")).alias("tokens"), X.count_chars(F.col("text")).alias("chars"))
    measures = ("lines", "tokens", "chars")
    out = []
    for c in measures:
        out += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.round(F.percentile(c, F.lit(0.5)), 6).alias(f"{c}_median")]
    return own.groupBy(group).agg(*out)


def tokenized(corpus: DataFrame) -> DataFrame:
    """``id, tokens``: the abstract sequences of normalized text; blank texts are left out."""
    return normalized(corpus).where(F.trim("norm_text") != "").select("id", T.categories(F.col("norm_text")).alias("tokens"))


def token_records(corpus: DataFrame) -> DataFrame:
    """Token records with the statistics of a light syntax tree."""
    own = normalized(corpus).where(F.trim("norm_text") != "").select("id", T.syntax(F.col("norm_text")).alias("s"))
    s = F.col("s")
    return own.select(
        "id",
        s["token_ids"].alias("token_ids"),
        F.size(s["token_ids"]).cast("long").alias("token_count"),
        F.struct(
            F.array_max(s["depths"]).cast("long").alias("max_depth"),
            F.size(s["types"]).cast("long").alias("node_count"),
            T.count_categories(s["types"]).alias("histogram"),
            T.bigrams(s["types"], s["parents"]).alias("bigrams"),
            T.cyclomatic(s["types"]).alias("cyclomatic_complexity"),
        ).alias("ast"),
    )


def token_summary(rows: DataFrame) -> DataFrame:
    """Mean, median and largest token count and mean cyclomatic complexity of ``id, tokens``, in one pass."""
    own = rows.select(F.size("tokens").alias("n"), T.cyclomatic(F.col("tokens")).alias("cc"))
    median = F.round(F.percentile("n", F.lit(0.5)), 6)
    return own.agg(F.round(F.avg("n"), 6).alias("tokens_mean"), F.max("n").cast("long").alias("tokens_max"), F.round(F.avg("cc"), 6).alias("cc_mean"), median.alias("tokens_median"))


def category_totals(rows: DataFrame) -> DataFrame:
    """How often each category occurs in all of ``id, tokens``, OTHER included."""
    return rows.select(F.explode("tokens").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def distinct_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id1").alias("id")).union(pairs.select("id2")).distinct()
