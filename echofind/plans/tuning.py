"""Experiments over band parameters: a theoretical sweep, and recommendation by constraints."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clones


def _series(spark: SparkSession, name: str, bounds: tuple[int, int, int]) -> DataFrame:
    return spark.range(*bounds).select(F.col("id").alias(name))


def sweep(spark: SparkSession, positives: int, negatives: int, hashes=(64, 256, 64), bands=(2, 32, 2), ks=(3, 5, 1), hit_rate: float = 0.95) -> DataFrame:
    """Expected metrics of every dividing combination (upper bounds excluded), by closed formulas."""
    grid = _series(spark, "n_hashes", hashes).crossJoin(_series(spark, "n_bands", bands)).crossJoin(_series(spark, "shingle_k", ks))
    grid = grid.where(F.col("n_hashes") % F.col("n_bands") == 0)
    rows = F.floor(F.col("n_hashes") / F.col("n_bands"))
    out = grid.withColumn("rows_per_band", rows).withColumn("threshold", F.when(F.col("rows_per_band") > 0, F.pow(1 / F.col("n_bands"), 1 / F.col("rows_per_band"))).otherwise(0.5))
    tp = int(positives * hit_rate)
    out = out.withColumns({"tp": F.lit(tp).cast("long"), "fp": F.floor(negatives * ((1 - F.col("threshold")) * 0.3)).cast("long")})
    total = F.col("tp") + F.col("fp")
    out = out.withColumns(
        {
            "fn": F.lit(positives - tp).cast("long"),
            "tn": F.lit(negatives).cast("long") - F.col("fp"),
            "recall": F.lit(tp / max(positives, 1)),
            "precision": F.col("tp") / F.greatest(total, F.lit(1)),
            "reduction": 1 - total / max(positives + negatives, 1),
            "seconds": (positives + negatives) * 0.001 * (F.col("n_hashes") / 128) * (F.col("n_bands") / 16),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"f1": f1, "balanced": 0.4 * r + 0.3 * p + 0.3 / (1 + F.col("seconds"))})


def best(rows: DataFrame, by: Column) -> DataFrame:
    """The first of the best rows, in the order of the parameters."""
    order = Window.orderBy(by.desc(), "n_hashes", "n_bands", "shingle_k")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def recommend(rows: DataFrame, min_recall: float = 0.9, min_precision: float = 0.5, max_seconds: float = 5.0, alternatives: int = 3) -> DataFrame:
    """The best F1 under the constraints and up to three alternatives; if none meets them, those of nine tenths of the recall."""
    strict = (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision) & (F.col("seconds") <= max_seconds)
    tiered = rows.withColumn("tier", F.when(strict, 1).when(F.col("recall") >= 0.9 * min_recall, 2)).where("tier is not null")
    chosen = tiered.join(F.broadcast(tiered.agg(F.min("tier").alias("least"))), F.col("tier") == F.col("least")).drop("least")
    order = Window.orderBy(F.col("f1").desc(), "n_hashes", "n_bands", "shingle_k")
    return chosen.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= 1 + alternatives)


def heatmap(rows: DataFrame, value: str, columns: list[int]) -> DataFrame:
    """The first ``value`` (by shingle length) of every pair of bands and hashes, hashes as columns."""
    first = lambda h: F.min_by(F.when(F.col("n_hashes") == h, F.col(value)), F.when(F.col("n_hashes") == h, F.col("shingle_k")))
    return rows.groupBy("n_bands").agg(*(first(h).alias(f"h{h}") for h in columns))


def empirical(pairs: DataFrame, truth: DataFrame, shingles: DataFrame, hashes: Sequence[int] = (32, 36, 40, 44, 48), bands: Iterable[int] = range(8, 14), seed: int = 42) -> DataFrame:
    """Real candidate metrics of a pair list for every dividing combination, from one signature table of the most hashes."""
    signed = clones.signatures(shingles, max(hashes), seed).cache()
    total = pairs.count()
    parts = []
    for h in hashes:
        for b in bands:
            if h % b == 0:
                hit = clones.filtered(pairs, clones.band_keys(signed, h, b))
                parts.append(clones.candidate_metrics(hit, truth, total).select(F.lit(h).alias("n_hashes"), F.lit(b).alias("n_bands"), "*"))
    return reduce(DataFrame.union, parts)
