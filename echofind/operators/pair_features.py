"""The feature table of snippet pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import tokens as T
from .clones import attach
from .metrics import joined, quantiles

#: Feature names in the order of the published table.
PARITY = (
    "lex_levenshtein_ratio lex_token_set_ratio lex_sequence_match_ratio lex_jaccard_tokens lex_dice_tokens lex_lcs_ratio lex_char_jaccard "
    "struct_ast_hist_cosine struct_bigram_cosine struct_depth_diff struct_depth_ratio struct_node_count1 struct_node_count2 struct_node_ratio struct_node_diff "
    "quant_token_ratio quant_line_delta quant_identifier_ratio quant_cc1 quant_cc2 quant_cc_ratio quant_cc_diff quant_lines1 quant_lines2 quant_chars1 quant_chars2 quant_char_ratio"
).split()
#: What the table holds under those names, by the names that say so.
TRUTHFUL = {
    "lex_sequence_match_ratio": "lex_token_jaccard",
    "lex_jaccard_tokens": "lex_token_dice",
    "struct_bigram_cosine": "struct_bigram_overlap",
}


def describe(corpus: DataFrame, records: DataFrame) -> DataFrame:
    """``id`` and what pairs need of a snippet; token records joined with lines and characters of the raw text."""
    return described(records, corpus.select("id", X.count_lines(F.col("text")).alias("lines"), X.count_chars(F.col("text")).alias("chars")))


def described(records: DataFrame, raw: DataFrame) -> DataFrame:
    """The same from given ``id, lines, chars``; a snippet without those has 0 of both."""
    a = F.col("ast")
    return records.join(raw, "id", "left").select(
        "id", F.col("token_ids").alias("t"), F.col("token_count").alias("n"), a["max_depth"].alias("depth"), a["node_count"].alias("nodes"),
        a["histogram"].alias("h"), a["bigrams"].alias("b"), a["cyclomatic_complexity"].alias("cc"),
        F.coalesce("lines", F.lit(0).cast("long")).alias("lines"), F.coalesce("chars", F.lit(0).cast("long")).alias("chars"),
    )


def pair_features(pairs: DataFrame, described: DataFrame, parity: bool = False) -> DataFrame:
    """All features of the pairs whose snippets are both described.

    ``parity`` gives the 27 published names, among them one that is constantly 0 and one that
    repeats; without it every column has a name that says what it holds, once.
    """
    full = attach(pairs, described, ["t", "n", "depth", "nodes", "h", "b", "cc", "lines", "chars"])
    c = lambda name: (F.col(f"{name}1"), F.col(f"{name}2"))
    gap = lambda a, b: F.abs(a - b).cast("double")
    spelled = S.spelled(F.col("t1")), S.spelled(F.col("t2"))
    lcs = S.lcs_ratio("t1", "t2", whole=not parity)  # the published column looks at the first tokens only
    columns = {
        "lex_levenshtein_ratio": S.levenshtein_ratio(*spelled),
        "lex_token_set_ratio": F.lit(0.0),
        "lex_sequence_match_ratio": S.jaccard(*c("t")),
        "lex_jaccard_tokens": S.dice(*c("t")),
        "lex_dice_tokens": lcs,
        "lex_lcs_ratio": lcs,
        "lex_char_jaccard": S.char_jaccard(*spelled),
        "struct_ast_hist_cosine": S.cosine(*c("h")),
        "struct_bigram_cosine": S.bigram_overlap(*c("b")),
        "struct_depth_diff": gap(*c("depth")),
        "struct_depth_ratio": S.ratio(*c("depth")),
        "struct_node_count1": F.col("nodes1"),
        "struct_node_count2": F.col("nodes2"),
        "struct_node_ratio": S.ratio(*c("nodes")),
        "struct_node_diff": gap(*c("nodes")),
        "quant_token_ratio": S.ratio(*c("n")),
        "quant_line_delta": F.abs(F.col("lines1") - F.col("lines2")) / F.greatest("lines1", "lines2", F.lit(1)),
        "quant_identifier_ratio": S.identifier_ratio(*c("t")),
        "quant_cc1": F.col("cc1"),
        "quant_cc2": F.col("cc2"),
        "quant_cc_ratio": S.ratio(*c("cc")),
        "quant_cc_diff": gap(*c("cc")),
        "quant_lines1": F.col("lines1"),
        "quant_lines2": F.col("lines2"),
        "quant_chars1": F.col("chars1"),
        "quant_chars2": F.col("chars2"),
        "quant_char_ratio": F.least("chars1", "chars2") / F.greatest("chars1", "chars2", F.lit(1)),
    }
    if not parity:
        columns = {TRUTHFUL.get(k, k): v for k, v in columns.items() if k not in ("lex_token_set_ratio", "lex_dice_tokens")}
    return full.select(*pairs.columns, *(v.cast("double").alias(k) for k, v in columns.items()))


def selected(df: DataFrame, wanted: list[str], keep: tuple[str, ...] = ("id1", "id2", "label")) -> DataFrame:
    """The ids, the label and those of the wanted features that the table has, in the order wanted."""
    return df.select(*(c for c in keep if c in df.columns), *(c for c in dict.fromkeys(wanted) if c in df.columns and c not in keep))


def labelled(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Features with the ``label`` of their pair; a table that has one stays as it is, pairs without a label go."""
    if "label" in features.columns:
        return features
    return features.join(pairs.select("id1", "id2", "label"), ["id1", "id2"])


def sanitized(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and minus infinity as 0, infinity as 1."""
    fix = lambda x: F.when(F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x)
    return df.withColumns({c: fix(F.col(c).cast("double")) for c in columns})


def feature_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature, over finite values: mean, deviation, extremes, quartiles."""
    pairs = F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))
    long = df.select(pairs.alias("feature", "value")).where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    own = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max")
    )
    middle = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return joined(own, quantiles(long, ["feature"], "value", middle), ["feature"], {k: F.round(k, 6) for k in middle})


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all pairs of features: ``feature1, feature2, r``; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.stack(F.lit(len(pairs)), *(x for k, (a, b) in enumerate(pairs) for x in (F.lit(a), F.lit(b), F.round(f"c{k}", 6)))).alias("feature1", "feature2", "r"))
