"""Robustness, stability and ablation of models, and resource profiles."""

from __future__ import annotations

import random
import time
import tracemalloc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics
from . import models

GROUPS = ("lex_", "struct_", "quant_")
LEVELS = (0.05, 0.1, 0.15, 0.2, 0.25)


def noisy(df: DataFrame, features: Sequence[str], level: float, seed: int = 42) -> DataFrame:
    """Gaussian noise of ``level`` deviations of each feature; a feature of no deviation counts as one."""
    spread = df.agg(*(F.stddev_pop(c).alias(f"_{c}") for c in features))
    own = df.join(F.broadcast(spread))
    out = {c: F.col(c) + F.randn(seed + i) * level * F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(1.0) for i, c in enumerate(features)}
    return own.withColumns(out).select(*df.columns)


def masked(df: DataFrame, features: Sequence[str], ratio: float, seed: int = 42) -> DataFrame:
    """A share of the features, drawn at random, set to 0."""
    drawn = random.Random(seed).sample(list(features), int(len(features) * ratio))
    return df.withColumns({c: F.lit(0.0) for c in drawn}) if drawn else df


def shifted(df: DataFrame, features: Sequence[str], ratio: float, seed: int = 42) -> DataFrame:
    """Each feature moved by a share of its size, up or down as drawn per feature."""
    rng = random.Random(seed)
    return df.withColumns({c: F.col(c) + rng.choice((-1, 1)) * ratio * F.abs(c) for c in features})


PERTURBATIONS: dict[str, Callable[..., DataFrame]] = {"noise": noisy, "mask": masked, "shift": shifted}


def robustness(model: Model, test: DataFrame, features: Sequence[str], kind: str = "noise", levels: Sequence[float] = LEVELS, seed: int = 42) -> DataFrame:
    """``level, f1, accuracy, degradation``: level 0 is the test set as it is."""
    parts = []
    for level in (0.0, *levels):
        own = PERTURBATIONS[kind](test, features, level, seed) if level else test
        cells = metrics.classification(metrics.confusion(models.scored(model, own, features), F.col("label"), F.col("prediction")))
        parts.append(cells.select(F.lit(level).alias("level"), "f1", "accuracy"))
    rows = reduce(DataFrame.union, parts)
    base = F.max(F.when(F.col("level") == 0, F.col("f1"))).over(Window.partitionBy())
    return rows.select("level", "f1", "accuracy", F.round(base - F.col("f1"), 6).alias("degradation"))


def robustness_ranking(curves: DataFrame) -> DataFrame:
    """Of ``model, level, f1``: the mean F1 over the range of levels (area under the curve over its width), and the rank, the most robust first."""
    order = Window.partitionBy("model").orderBy("level")
    step = F.col("level") - F.lag("level").over(order)
    pieces = curves.select("model", "level", (step * (F.col("f1") + F.lag("f1").over(order)) / 2).alias("piece"))
    own = pieces.groupBy("model").agg(F.round(metrics.share(F.sum("piece"), F.max("level") - F.min("level")), 6).alias("robustness"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.col("robustness").desc(), "model")).cast("long"))


def importance_stability(df: DataFrame, features: Sequence[str], name: str = "forest", k: int = 5, seed: int = 42, trees: int = 50) -> DataFrame:
    """Per feature over folds: mean, deviation, coefficient of variation and ranks of importance, and whether it is stable."""
    rows = [(fold, f, v) for fold in range(k) for f, v in models.importances(models.fitted(df.where(F.col("fold") != fold), features, name, seed, trees), features)]
    return importance_ranks(df.sparkSession.createDataFrame(rows, "fold long, feature string, importance double"))


def importance_ranks(long: DataFrame) -> DataFrame:
    """The same of given ``fold, feature, importance``."""
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature")))
    out = ranked.groupBy("feature").agg(
        F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"), F.min("importance").alias("min"), F.max("importance").alias("max"), F.avg("rank").alias("rank_mean"), F.stddev_pop("rank").alias("rank_std")
    )
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(float("inf"))
    return out.withColumn("cv", cv).withColumn("verdict", F.when(cv < 0.5, "stable").when(cv > 1, "unstable").otherwise("medium"))


def prediction_stability(predictions: DataFrame) -> DataFrame:
    """Of ``id, model, prediction, label``: accuracy per model and its agreement with the rounded mean of all models."""
    mean = predictions.groupBy("id").agg(F.round(F.avg("prediction")).cast("int").alias("common"))
    own = predictions.join(mean, "id")
    return own.groupBy("model").agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("prediction") == F.col("common")).cast("double")), 6).alias("agreement"))


def without(df: DataFrame, features: Sequence[str], dropped: Sequence[Sequence[str]], names: Sequence[str], model: str = "forest", k: int = 3, seed: int = 42, trees: int = 50) -> DataFrame:
    """Mean F1 of the full features ("full") and without each group, and the change, the largest loss first."""
    parts = []
    for name, gone in (("full", ()), *zip(names, dropped, strict=True)):
        left = [f for f in features if f not in gone]
        own = df if left else df.withColumn("_none", F.lit(0.0))
        folds = models.cross_validated(own, left or ["_none"], [model], k, seed, trees)
        parts.append(folds.where("metric = 'f1'").agg(F.lit(name).alias("config"), F.round(F.avg("value"), 6).alias("f1")))
    return metrics.ablation(reduce(DataFrame.union, parts), "full")


def one_feature_out(df: DataFrame, features: Sequence[str], **more) -> DataFrame:
    return without(df, features, [[f] for f in features], list(features), **more)


def one_group_out(df: DataFrame, features: Sequence[str], groups: Sequence[str] = GROUPS, **more) -> DataFrame:
    return without(df, features, [[f for f in features if f.startswith(g)] for g in groups], list(groups), **more)


def zeroed_groups(model: Model, test: DataFrame, features: Sequence[str], groups: Sequence[str] = GROUPS) -> DataFrame:
    """F1 of a fitted model as it is ("full") and with the features of each prefix set to 0, ranked as ablations are."""
    parts = []
    for name in ("full", *groups):
        own = test.withColumns({c: F.lit(0.0) for c in features if name != "full" and c.startswith(name)})
        cells = metrics.classification(metrics.confusion(models.scored(model, own, features), F.col("label"), F.col("prediction")))
        parts.append(cells.select(F.lit(name).alias("config"), "f1"))
    return metrics.ablation(reduce(DataFrame.union, parts), "full")


def runtime_ablation(rows: DataFrame, baseline: str) -> DataFrame:
    """Of ``config, seconds``: time saved, share saved and speed-up against the baseline."""
    base = rows.where(F.col("config") == baseline).select(F.col("seconds").alias("base"))
    saved = F.col("base") - F.col("seconds")
    return rows.join(F.broadcast(base)).select("config", "seconds", saved.alias("saved"), metrics.share(saved, F.col("base")).alias("reduction"), metrics.share(F.col("base"), F.col("seconds")).alias("speedup"))


class Profile:
    """Seconds and the driver's peak memory per stage; ``rows`` gives a table, ``advice`` what stands out."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, float, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        nested = tracemalloc.is_tracing()
        if not nested:
            tracemalloc.start()
        tracemalloc.reset_peak()
        began = time.perf_counter()
        try:
            yield
        finally:
            peak = tracemalloc.get_traced_memory()[1] / 1e6
            if not nested:
                tracemalloc.stop()
            self.stages.append((name, time.perf_counter() - began, peak))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, "stage string, seconds double, peak_mb double")

    @staticmethod
    def totals(rows: DataFrame) -> DataFrame:
        return rows.agg(F.sum("seconds").alias("seconds"), F.max("peak_mb").alias("peak_mb"), F.max_by("stage", "peak_mb").alias("largest_stage"), F.max_by("stage", "seconds").alias("slowest_stage"))

    @staticmethod
    def advice(rows: DataFrame, memory_mb: float = 100, seconds: float = 10, severe_mb: float = 500) -> DataFrame:
        word = F.when(F.col("peak_mb") > severe_mb, "stream it").when(F.col("peak_mb") > memory_mb, "use less memory").when(F.col("seconds") > seconds, "use more tasks")
        return rows.select("stage", word.alias("advice")).where("advice is not null")
