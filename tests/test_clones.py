import pytest

from echofind.operators import clones


def test_parameters():
    assert clones.checked(48, 16, 3) == (16, 3)
    assert clones.checked(8, 20, 1) == (8, 1)
    assert clones.checked(50, 16, 1) == (16, 3)
    with pytest.raises(ValueError):
        clones.checked(0, 1, 1)


def test_classes_and_types(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id int, t string")
    assert {(r.id, r.class_id, r.class_size) for r in clones.classes(df, F.col("t")).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}
    corpus = spark.createDataFrame([(1, "x", "k"), (2, "x", "k"), (3, "y", "k"), (4, "z", "m")], "id int, norm_md5 string, token_md5 string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 9)], "id1 int, id2 int")
    assert {(r.id2, r.clone_type) for r in clones.clone_types(pairs, corpus).collect()} == {(2, 1), (3, 2), (4, 0), (9, 0)}


def test_bands(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text), (3, text.replace("w7 ", "v7 ")), (4, "quite another one"), (5, "short"), (6, "")], "id int, text string")
    signed = clones.signatures(clones.word_shingles(df), 48)
    assert {r.id for r in signed.collect()} == {1, 2, 3, 4}
    keyed = clones.band_keys(signed, 48, 16)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "id1 int, id2 int")
    hit = {(r.id1, r.id2) for r in clones.filtered(pairs, keyed).collect()}
    assert (1, 2) in hit and (1, 4) not in hit and (1, 5) not in hit
    rows = clones.buckets(keyed)
    full = {(r.id1, r.id2) for r in clones.bucket_pairs(rows).collect()}
    assert hit <= full and clones.bucket_pairs(rows, 1).count() == 0
    similar = {(r.id2): r.similarity for r in clones.agreement(pairs, signed).collect()}
    assert similar[2] == 1 and similar[4] < 0.5


def test_candidate_metrics(spark):
    c = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "id1 int, id2 int")
    t = spark.createDataFrame([(1, 2), (3, 4), (7, 8)], "id1 int, id2 int")
    r = clones.candidate_metrics(c, t, 100).first()
    assert (r.reduction, r.candidate_recall, r.candidate_precision) == (0.97, 0.666667, 0.666667)
    none = clones.candidate_metrics(c.limit(0), t.limit(0), 0).first()
    assert (none.reduction, none.candidate_recall, none.candidate_precision) == (0, 0, 0)


def test_merge_and_reports(spark):
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 3), (1, 4, 0), (1, 5, 3)], "id1 int, id2 int, label int")
    cand = spark.createDataFrame([(1, 3, 1), (1, 4, 1)], "id1 int, id2 int, model int")
    rules = spark.createDataFrame([(1, 2, 1), (1, 3, 0)], "id1 int, id2 int, clone_type int")
    out = clones.merged_predictions(pairs, cand, rules)
    assert {(r.id2, r.prediction) for r in out.collect()} == {(2, 1), (3, 3), (4, 3), (5, 0)}
    assert [tuple(r) for r in clones.rule_report(out).collect()] == [(1, 1, 0, 0, 1.0, 1.0), (2, 0, 0, 0, 0.0, 0.0)]
    assert {tuple(r) for r in clones.pivoted_confusion(out, [0, 1, 3]).collect()} == {(1, 0, 1, 0), (3, 1, 0, 1), (0, 0, 0, 1)}
    rows = spark.createDataFrame([(1, 2, "a", 1), (1, 2, "b", 2)], "id1 int, id2 int, v string, o int")
    assert [tuple(r) for r in clones.last_wins(rows, ["id1", "id2"], "o").collect()] == [(1, 2, "b", 2)]
