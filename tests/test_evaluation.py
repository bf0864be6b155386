import math
import random

import pytest
from pyspark.sql import functions as F

from echofind.operators import metrics, neighbours, splits
from echofind.plans import tuning


def test_classification(spark):
    perfect = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "y int, p int")
    r = metrics.classification(metrics.confusion(perfect, F.col("y"), F.col("p"))).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1)
    r = metrics.classification(metrics.confusion(perfect.withColumn("p", 1 - F.col("p")), F.col("y"), F.col("p"))).first()
    assert (r.accuracy, r.fp, r.f1) == (0, 2, 0)
    assert metrics.classification(metrics.confusion(perfect.limit(0), F.col("y"), F.col("p"))).first().f1 == 0


def test_ranking(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(20) / 20) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc, abs=1e-6)
    ap = sum(sum(1 for y, s in rows if y and s == t) * sum(y for y, s in rows if s >= t) / sum(1 for y, s in rows if s >= t) for t in {s for _, s in rows}) / len(pos)
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(ap, abs=1e-6)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] == 0
    curve = metrics.interpolated(metrics.curves(df, "y", "s"), "fpr", "tpr")
    assert curve.count() == 100
    best = metrics.best_threshold(metrics.threshold_sweep(df, "y", "s")).first()
    assert best.best >= best.usual
    assert metrics.calibration_bins(df, "y", "s").agg(F.sum("n")).first()[0] == 300


def test_folds_and_ablation(spark):
    long = spark.createDataFrame([("m", k, "f1", v) for k, v in enumerate((0.9, 0.92, 0.88))] + [("c", k, "f1", 0.5) for k in range(3)], "model string, fold int, metric string, value double")
    s = metrics.fold_summary(long)
    rows = {r.model: r for r in s.collect()}
    assert rows["m"]["mean"] == 0.9
    stable = {r.model: r for r in metrics.fold_stability(s).collect()}
    assert (stable["c"].cv, stable["c"].stability) == (0, 1)
    out = metrics.ablation(spark.createDataFrame([("full", 0.95), ("less", 0.9)], "config string, f1 double"), "full").collect()
    assert out[0].config == "less" and out[0].delta == -0.05 and out[0].percent < 0
    sizes = spark.createDataFrame([(3, 0.5), (5, 0.8), (8, 0.805), (10, 0.9)], "n int, f1 double")
    assert metrics.elbow(sizes).first()[0] == 5
    assert metrics.area(sizes.select(F.col("n").alias("x"), F.lit(2.0).alias("y")), "x", "y").first()[0] == 2


def test_splits(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(300)], "id int, label string")
    split = splits.stratified_split(df, "label", ["id"])
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("a", "test"): 60, ("a", "train"): 140, ("b", "test"): 30, ("b", "train"): 70}
    assert {r["count"] for r in splits.balanced(df, "label", ["id"]).groupBy("label").count().collect()} == {100}
    folds = {(r.label, r.fold): r["count"] for r in splits.folds(df, "label", ["id"]).groupBy("label", "fold").count().collect()}
    assert set(folds.values()) == {20, 40}
    assert splits.subset(df, "label", ["id"], 7).count() == 14
    assert split.exceptAll(splits.stratified_split(df, "label", ["id"])).count() == 0
    assert splits.balanced(df.limit(0), "label", ["id"]).count() == 0


def test_datasets_and_validation(spark):
    rows = [(f"{s}{k}a", f"{s}{k}b", s) for s in ("type1", "type2", "type3", "type4", "type5", "nonclone") for k in range(20)]
    df = spark.createDataFrame(rows, "id1 string, id2 string, clone_set string")
    train, test = splits.datasets(df, ["id1", "id2"])
    assert {r.label: r["count"] for r in train.groupBy("label").count().collect()} == {0: 28, 1: 28}
    assert {r.label: r["count"] for r in test.groupBy("label").count().collect()} == {0: 12, 1: 20, 2: 20, 3: 12}
    ids = spark.createDataFrame([("type10a",), ("type10b",)], "id string")
    valid, stats = splits.existing(df, ids, "clone_set")
    assert valid.count() == 1
    assert {(r.clone_set, r.removed) for r in stats.collect()} >= {("type1", 19), ("type2", 20)}


def test_tuning(spark):
    rows = tuning.sweep(spark, 100, 900)
    assert rows.where("n_hashes % n_bands <> 0").count() == 0 and rows.where("recall > 1 or precision > 1").count() == 0
    given = spark.createDataFrame([(64, 8, 3, 0.95, 0.6, 0.74, 1.5), (64, 16, 3, 0.9, 0.55, 0.68, 0.8)], "n_hashes int, n_bands int, shingle_k int, recall double, precision double, f1 double, seconds double")
    best = tuning.recommend(given).collect()
    assert best[0].recall == 0.95 and len(best) <= 4
    assert tuning.recommend(given.withColumns({"recall": F.lit(0.8), "precision": F.lit(0.4)})).count() == 0


def test_nearest(spark):
    rng = random.Random(6)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(60)] + [(100, None), (None, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in neighbours.nearest(df.where("id < 3"), df, 5, block=2).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id))
    for q in range(3):
        want = sorted((math.dist(rows[q][1], v), k) for k, v in rows[:60] if k != q)[:5]
        assert [i for _, i in sorted(got[q])] == [k for _, k in want]
