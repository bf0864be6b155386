"""Exact and renamed copies, candidates by MinHash bands, and the evaluation of detections."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H

log = logging.getLogger(__name__)


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller id first."""
    return pairs.withColumns({"id1": F.least("id1", "id2"), "id2": F.greatest("id1", "id2")})


def classes(rows: DataFrame, key: Column) -> DataFrame:
    """``id, class_id, class_size``: the smallest id and the size of the class of equal keys; no pairs are made."""
    keyed = rows.select("id", key.alias("k"))
    groups = keyed.groupBy("k").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(groups, "k").select("id", "class_id", "class_size")


def attach(pairs: DataFrame, rows: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Pairs with the given columns of both sides, suffixed 1 and 2."""
    for side in ("1", "2"):
        own = rows.select(F.col("id").alias(f"id{side}"), *(F.col(c).alias(f"{c}{side}") for c in columns))
        pairs = pairs.join(own, f"id{side}", how)
    return pairs


def clone_types(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs with ``clone_type`` 1 (equal normalized text), 2 (equal token sequence) or 0; pairs that lack a snippet get 0.

    ``corpus`` has ``id, norm_md5, token_md5``, the digests of both.
    """
    full = attach(pairs, corpus, ["norm_md5", "token_md5"], "left")
    kind = F.when(F.col("norm_md51") == F.col("norm_md52"), 1).when(F.col("token_md51") == F.col("token_md52"), 2).otherwise(0)
    return full.select(*pairs.columns, kind.alias("clone_type"))


def checked(hashes: int, bands: int, k: int) -> tuple[int, int]:
    """Valid bands and rows per band; more bands than hashes are as many, a remainder of hashes stays unused."""
    if hashes < 1 or bands < 1 or k < 1:
        raise ValueError("hashes, bands and k must be positive")
    bands = min(bands, hashes)
    if hashes % bands:
        log.warning("%d hashes do not divide into %d bands: the last %d are unused", hashes, bands, hashes % bands)
    return bands, hashes // bands


def word_shingles(corpus: DataFrame, k: int = 3) -> DataFrame:
    """``id, shingle``: distinct keys of the word k-grams of every text."""
    words = F.filter(F.split(F.col("text"), " "), lambda w: w != "")
    rows = corpus.select("id", words.alias("w")).where(F.size("w") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
    return rows.select("id", F.explode(F.array_distinct(grams)).alias("g")).select("id", H.word_key(F.col("g")).alias("shingle"))


def signatures(shingles: DataFrame, hashes: int = 48, seed: int = 42) -> DataFrame:
    """``id, m0 .. m{hashes-1}``: one aggregation with a minimum per hash, partial before the shuffle."""
    own = [F.min(H.affine(F.col("shingle"), a, b)).alias(f"m{i}") for i, (a, b) in enumerate(H.coefficients(hashes, seed))]
    return shingles.groupBy("id").agg(*own)


def signatures64(shingles: DataFrame, hashes: int = 48, seed: int = 42) -> DataFrame:
    """The same with the 64-bit family over 64-bit shingles; minima are unsigned, as signed patterns."""
    own = [F.min(H.unsigned(H.affine64(F.col("shingle"), a, b))).alias(f"m{i}") for i, (a, b) in enumerate(H.coefficients64(hashes, seed))]
    return shingles.groupBy("id").agg(*own).select("id", *(H.unsigned(F.col(f"m{i}")).alias(f"m{i}") for i in range(hashes)))


def band_keys(signed: DataFrame, hashes: int = 48, bands: int = 16) -> DataFrame:
    """``id, bands``: a key per band, its minima joined."""
    bands, rows = checked(hashes, bands, 1)
    keys = [F.concat_ws("-", *(F.col(f"m{b * rows + r}") for r in range(rows))) for b in range(bands)]
    return signed.select("id", F.array(*keys).alias("bands"))


def buckets(keyed: DataFrame) -> DataFrame:
    """``id, band, bucket``."""
    return keyed.select("id", F.posexplode("bands").alias("band", "bucket")).select("id", F.col("band").cast("long").alias("band"), "bucket")


def filtered(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The given pairs that share a band; no pairs beyond the list are made."""
    full = attach(pairs, keyed, ["bands"])
    shared = F.exists(F.zip_with("bands1", "bands2", lambda x, y: x == y), lambda x: x)
    return full.where(shared).select(*pairs.columns)


def bucket_pairs(rows: DataFrame, max_bucket_size: int | None = None) -> DataFrame:
    """Distinct pairs of ids that share a bucket.

    Without a cap every bucket counts.  With one, larger buckets are skipped, as a feature of
    the operator; feed it one id per class of equal texts to keep buckets small.
    """
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    if max_bucket_size is not None:
        sizes = sizes.where(F.col("n") <= max_bucket_size)
    own = rows.join(sizes.select("band", "bucket"), ["band", "bucket"])
    x, y = own.alias("x"), own.alias("y")
    both = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")))
    return both.select(F.col("x.id").alias("id1"), F.col("y.id").alias("id2")).distinct()


def agreement(pairs: DataFrame, signed: DataFrame, hashes: int = 48) -> DataFrame:
    """Pairs with ``similarity``: the share of equal minima, cut to four digits."""
    columns = [f"m{i}" for i in range(hashes)]
    full = attach(pairs, signed, columns)
    same = sum(((F.col(f"{c}1") == F.col(f"{c}2")).cast("long") for c in columns), F.lit(0).cast("long"))
    return full.select(*pairs.columns, (F.floor(same * 10000 / hashes) / 10000).alias("similarity"))


def candidate_metrics(candidates: DataFrame, truth: DataFrame, total: int | Column) -> DataFrame:
    """Pairs before and after, true ones retained, reduction, recall and precision; 0 where undefined."""
    c = candidates.select("id1", "id2").distinct().withColumn("c", F.lit(1))
    t = truth.select("id1", "id2").distinct().withColumn("t", F.lit(1))
    both = c.join(t, ["id1", "id2"], "full_outer")
    n = both.agg(F.count("c").alias("candidates"), F.count("t").alias("true_pairs"), F.count(F.when(F.col("c").isNotNull() & F.col("t").isNotNull(), 1)).alias("true_retained"))
    all_ = (F.lit(total) if isinstance(total, int) else total).cast("long")
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    return n.select(
        all_.alias("pairs_before"), F.col("candidates").alias("pairs_after"), "true_pairs", "true_retained",
        F.when(all_ > 0, F.round(1 - F.col("candidates") / all_, 6)).otherwise(0.0).alias("reduction"),
        share(F.col("true_retained"), F.col("true_pairs")).alias("candidate_recall"),
        share(F.col("true_retained"), F.col("candidates")).alias("candidate_precision"),
    )


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one of the largest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def merged_predictions(pairs: DataFrame, candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """``id1, id2, label, prediction``: the rule's type, else 3 where the model says so among candidates, else 0."""
    out = pairs.join(candidates.select("id1", "id2", "model"), ["id1", "id2"], "left").join(rules.select("id1", "id2", "clone_type"), ["id1", "id2"], "left")
    rule = F.when(F.col("clone_type").isin(1, 2), F.col("clone_type"))
    return out.select("id1", "id2", "label", F.coalesce(rule, F.when(F.col("model") == 1, 3), F.lit(0)).alias("prediction"))


def rule_report(rows: DataFrame) -> DataFrame:
    """Per rule type, over all pairs: true and false positives, false negatives, recall and precision."""
    out = None
    for kind in (1, 2):
        tp, fp, fn = ((F.col("label") == kind) & (F.col("prediction") == kind)), ((F.col("label") != kind) & (F.col("prediction") == kind)), ((F.col("label") == kind) & (F.col("prediction") != kind))
        n = rows.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("tp", tp), ("fp", fp), ("fn", fn))))
        share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
        one = n.select(F.lit(kind).alias("clone_type"), "tp", "fp", "fn", share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
        out = one if out is None else out.union(one)
    return out


def pivoted_confusion(rows: DataFrame, labels: list[int]) -> DataFrame:
    """A row per label, a column per prediction."""
    names = [f"predicted_{x}" for x in labels]
    wide = rows.groupBy("label").agg(*(F.count(F.when(F.col("prediction") == x, 1)).alias(n) for x, n in zip(labels, names, strict=True)))
    return wide.select("label", *names)
