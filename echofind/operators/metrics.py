"""Metrics of classifications, rankings, folds and experiments, all as aggregations.

Ranking metrics first count rows per distinct score; windows see those counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _six(x: Column) -> Column:
    return F.round(x, 6)


def confusion(df: DataFrame, label: Column, prediction: Column, keys: list[str] | None = None) -> DataFrame:
    """``tp, fp, tn, fn`` of binary labels; what is none of the first, second and last counts as tn."""
    cells = {"tp": (label == 1) & (prediction == 1), "fp": (label == 0) & (prediction == 1), "fn": (label == 1) & (prediction == 0)}
    n = {k: F.count(F.when(c, 1)) for k, c in cells.items()}
    n["tn"] = F.count("*") - n["tp"] - n["fp"] - n["fn"]
    return df.groupBy(*(keys or [])).agg(*(v.alias(k) for k, v in n.items()))


def classification(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and error rates from ``confusion``; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    keys = [c for c in cells.columns if c not in ("tp", "fp", "tn", "fn")]
    out = {
        "accuracy": share(tp + tn, tp + fp + tn + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
        "f1": share(2.0 * tp, 2 * tp + fp + fn), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp),
    }
    return cells.select(*keys, "tp", "fp", "tn", "fn", *(_six(v).alias(k) for k, v in out.items()))


#: Parts that scores, of any range, are dealt into in their order (by a logistic curve).
PARTS = 4096


def _by_score(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Per distinct score (of each group): its part, positives and negatives, and both from the highest score down to it.

    Sums run within parts of the score range; only totals of parts meet in one window.
    """
    keys = keys or []
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))
    counts = counts.withColumn("part", F.floor(PARTS / (1 + F.exp(-F.col("score")))))
    above = Window.partitionBy(*keys).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*keys, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    parts = parts.select(*keys, "part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"))
    down = Window.partitionBy(*keys, "part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(parts, [*keys, "part"]).select(*keys, "part", "score", "p", "n", (F.col("p0") + F.sum("p").over(down)).alias("tp"), (F.col("n0") + F.sum("n").over(down)).alias("fp"))


def rankings(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """``roc_auc`` (ties counted half) and ``average_precision``, of each group; 0 if a class is missing."""
    wins = F.sum((F.col("tp") - F.col("p")) * F.col("n") + F.col("p") * F.col("n") / 2.0)
    precision = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    own = _by_score(df, label, score, keys).groupBy(*(keys or []))
    return own.agg(_six(share(wins, F.sum("p") * F.sum("n"))).alias("roc_auc"), _six(share(precision, F.sum("p"))).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 if a class is missing."""
    return rankings(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return rankings(df, label, score).select("average_precision")


def curves(df: DataFrame, label: str, score: str) -> DataFrame:
    """Points of the ROC and precision-recall curves, one per distinct score, and the upper envelope of precision."""
    own = _by_score(df, label, score).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    whole = F.broadcast(own.agg(F.sum("p").alias("ps"), F.sum("n").alias("ns")))
    below = Window.orderBy(F.col("part").desc()).rowsBetween(1, Window.unboundedFollowing)
    parts = own.groupBy("part").agg(F.max("precision").alias("best"))
    parts = parts.select("part", F.max("best").over(below).alias("rest"))
    rest = Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(0, Window.unboundedFollowing)
    envelope = F.greatest(F.max("precision").over(rest), F.col("rest"))
    return own.join(parts, "part").join(whole).select(
        "score", _six(share(F.col("fp"), F.col("ns"))).alias("fpr"), _six(share(F.col("tp"), F.col("ps"))).alias("tpr"), _six(F.col("precision")).alias("precision"), _six(envelope).alias("envelope")
    )


def interpolated(curve: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """A curve at ``points`` even places of [0, 1], linear between its points; ``grid, x, value``.

    Only the outermost points of each grid cell matter, so windows see two rows per cell.
    """
    spark = curve.sparkSession
    cell = F.floor(F.col(x) * (points - 1))
    ends = curve.groupBy(cell.alias("cell")).agg(F.min(F.struct(F.col(x).alias("x"), (-F.col(y)).alias("y"))).alias("a"), F.max(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("b"))
    both = ends.select(F.col("a.x").alias("x"), (-F.col("a.y")).alias("y")).union(ends.select("b.x", "b.y"))
    own = both.groupBy("x").agg(F.max("y").alias("y"))
    order = Window.orderBy("x")
    pieces = own.select("x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"), F.lag("x").over(order).alias("x0"))
    grid = spark.range(points).select(F.col("id").alias("grid"), (F.col("id") / (points - 1)).alias("g"))
    inside = (F.col("g") >= F.col("x")) & (F.coalesce(F.col("g") < F.col("x2"), F.lit(True))) | (F.col("x0").isNull() & (F.col("g") < F.col("x")))
    line = F.when(F.col("g") <= F.col("x"), F.col("y")).otherwise(F.coalesce(F.col("y") + (F.col("y2") - F.col("y")) * (F.col("g") - F.col("x")) / (F.col("x2") - F.col("x")), F.col("y")))
    return pieces.join(F.broadcast(grid), inside).select("grid", _six(F.col("g")).alias("x"), _six(line).alias("value"))


def threshold_sweep(df: DataFrame, label: str, score: str, low: int = 10, high: int = 89) -> DataFrame:
    """Metrics at thresholds of low to high hundredths: a row per threshold."""
    spark = df.sparkSession
    # the largest threshold that a score reaches, exact at the borders; rows per bin, so the grid meets a bounded table
    s, near = F.col(score), F.floor(F.col(score) * 100)
    reached = F.when(s >= (near + 1) / 100, near + 1).when(s < near / 100, near - 1).otherwise(near)
    bins = F.least(F.greatest(reached, F.lit(low - 1)), F.lit(high)).alias("s")
    counts = df.groupBy(bins).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) == 0, 1)).alias("n"))
    grid = F.broadcast(spark.range(low, high + 1).select(F.col("id").alias("percent")))
    hit = F.col("s") >= F.col("percent")
    cells = counts.join(grid).groupBy("percent").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("tn"), F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"),
    )
    return classification(cells)


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold of the best metric, the lowest of equals, against that of 50 percent."""
    best = sweep.agg(F.max_by(F.struct("percent", metric), F.struct(F.col(metric), -F.col("percent"))).alias("b"), F.max(F.when(F.col("percent") == 50, F.col(metric))).alias("usual"))
    gain = F.col("b")[metric] - F.col("usual")
    return best.select(F.col("b.percent").alias("percent"), F.col("b")[metric].alias("best"), "usual", _six(gain).alias("gain"), _six(100 * gain / F.greatest("usual", F.lit(0.001))).alias("gain_percent"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), _six(F.avg(score)).alias("mean_score"), _six(F.avg(label)).alias("share_positive"))


def brier_logloss(df: DataFrame, label: str, score: str) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label)
    return df.agg(_six(F.avg((F.col(score) - y) * (F.col(score) - y))).alias("brier"), _six(-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


#: Parts that the values of a group are dealt into for exact quantiles.
CUTS = 256


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, linear between neighbours: the keys and a column per wanted name.

    Rough quantiles of the distinct values deal the values of a group into parts in their order; counts of distinct
    values are summed within parts, and only totals of parts meet in one window.  No group, of
    whatever size, gathers in one task.
    """
    own = df.select(F.struct(*(keys or [F.lit(0).alias("_")])).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    counts = own.groupBy("k", "v").agg(F.count("*").alias("n"))
    cuts = counts.groupBy("k").agg(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts"))
    cuts = cuts.select(F.col("k").alias("c"), "cuts")
    dealt = counts.join(cuts, F.col("k") == F.col("c")).select("k", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    totals = dealt.groupBy("k", "part").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("k").alias("k2"), F.col("part").alias("part2"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"), F.sum("t").over(Window.partitionBy("k")).alias("size"))
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("sum", F.sum("n").over(inside)).join(totals, (F.col("k") == F.col("k2")) & (F.col("part") == F.col("part2")))
    end = F.col("base") + F.col("sum")
    placed = placed.select("k", "v", "size", (end - F.col("n")).alias("start"), end.alias("end"))
    picks = []
    for name, q in wanted.items():
        at = (F.col("size") - 1) * q
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("start") <= place) & (place < F.col("end")), F.col("v"))).alias(f"{name}_{side}"))
    found = placed.groupBy("k").agg(F.max("size").alias("size"), *picks)
    out = []
    for name, q in wanted.items():
        at = (F.col("size") - 1) * q
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*(F.col("k")[c].alias(c) for c in keys), *out)


def fold_summary(long: DataFrame) -> DataFrame:
    """Per model and metric of ``model, fold, metric, value``: mean, deviation, extremes."""
    return long.groupBy("model", "metric").agg(_six(F.avg("value")).alias("mean"), _six(F.stddev_pop("value")).alias("std"), _six(F.min("value")).alias("min"), _six(F.max("value")).alias("max"))


def fold_stability(summary: DataFrame) -> DataFrame:
    """Coefficient of variation and 1 / (1 + it); no mean, no stability."""
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(float("inf"))
    return summary.select("model", "metric", _six(cv).alias("cv"), _six(1 / (1 + cv)).alias("stability"))


def ablation(rows: DataFrame, baseline: str) -> DataFrame:
    """Change of every configuration of ``config, f1`` against the baseline, ranked: the largest loss first."""
    base = rows.where(F.col("config") == baseline).select(F.col("f1").alias("base"))
    delta = F.col("f1") - F.col("base")
    out = rows.join(F.broadcast(base)).select("config", "f1", _six(delta).alias("delta"), _six(share(100 * delta, F.col("base"))).alias("percent"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("delta", "config")).cast("long"))


def elbow(rows: DataFrame, gain: float = 0.01) -> DataFrame:
    """The first size of ``n, f1`` whose successor gains less than ``gain``, else the last."""
    step = F.lead("f1").over(Window.orderBy("n")) - F.col("f1")
    own = rows.select("n", "f1", step.alias("step"))
    return own.agg(F.coalesce(F.min(F.when(F.col("step") < gain, F.col("n"))), F.max("n")).alias("n"))


def area(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area under y over the range of x."""
    order = Window.orderBy(x)
    dx = F.col(x) - F.lag(x).over(order)
    own = rows.select(x, (dx * (F.col(y) + F.lag(y).over(order)) / 2).alias("piece"))
    return own.agg(_six(share(F.sum("piece"), F.max(x) - F.min(x))).alias("area"))


def distributions(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Quartiles and extremes of the columns per class."""
    pairs = F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))
    long = df.select(label, pairs.alias("feature", "value"))
    own = long.groupBy(label, "feature").agg(F.count("value").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))
    middle = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return joined(own, quantiles(long, [label, "feature"], "value", middle), [label, "feature"], {k: _six(F.col(k)) for k in middle})


def joined(own: DataFrame, more: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``own`` with columns of ``more`` by keys that may be null; both have a row per key."""
    renamed = more.select(*(F.col(k).alias(f"_{k}") for k in keys), *(v.alias(k) for k, v in columns.items()))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(renamed, same, "left").drop(*(f"_{k}" for k in keys))


def prediction_correlation(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Of ``id, model, prediction``: Pearson correlations of all pairs of models, ``model1, model2, r``; one pass."""
    wide = predictions.groupBy("id").agg(*(F.max(F.when(F.col("model") == m, F.col("prediction").cast("double"))).alias(f"m{k}") for k, m in enumerate(models)))
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    out = wide.agg(*(F.corr(f"m{i}", f"m{j}").alias(f"r{n}") for n, (i, j) in enumerate(pairs)))
    return out.select(F.stack(F.lit(len(pairs)), *(x for n, (i, j) in enumerate(pairs) for x in (F.lit(models[i]), F.lit(models[j]), F.round(f"r{n}", 6)))).alias("model1", "model2", "r"))
