import random

from pyspark.sql import functions as F

from echofind.functions import hashing as H
from echofind.functions import similarity as S
from echofind.operators import pair_features
from echofind.plans import catalog


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        assert S.lcs_length(a, b) == slow_lcs(a, b)


def test_empties_and_asymmetry(spark):
    df = spark.createDataFrame([([], []), ([1], []), ([5] * 100, [5]), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    rows = df.select(S.jaccard(F.col("a"), F.col("b")), S.dice(F.col("a"), F.col("b")), S.lcs_ratio("a", "b"), S.bigram_overlap(F.col("a"), F.col("b")), S.ratio(F.size("a"), F.size("b")), S.identifier_ratio(F.col("a"), F.col("b"))).collect()
    assert list(rows[0]) == [1, 1, 1, 0, 1, 1]
    assert list(rows[1]) == [0, 0, 0, 0, 0, 0]
    assert rows[2][3] == 100 / (100 + 1 - 100) and rows[2][0] == 1
    assert rows[3][0] == 1 / 3 and rows[3][1] == 0.5


def fnv(tokens):
    h = 0xCBF29CE484222325
    for t in tokens:
        for byte in t.to_bytes(4, "little"):
            h = (h ^ byte) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_shingles(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(256) for _ in range(n)],) for n in (0, 2, 3, 5, 20)]
    df = spark.createDataFrame(rows, "t array<int>")
    got = df.select("t", H.packed_shingles(F.col("t"), 3).alias("p"), H.fnv_shingles(F.col("t"), 3).alias("f")).collect()
    for r in got:
        windows = [r.t[i : i + 3] for i in range(max(0, len(r.t) - 2))]
        assert r.p == [a * 65536 + b * 256 + c for a, b, c in windows]
        assert r.f == [fnv(w) for w in windows]


def test_pair_features(spark):
    df = spark.createDataFrame([(1, "int a = 1;"), (2, "int a = 1;"), (3, "while (true) { x(); }")], "id int, text string")
    from echofind.operators import normalize

    described = pair_features.describe(df, normalize.token_records(df))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "id1 int, id2 int")
    out = {(r.id1, r.id2): r for r in pair_features.pair_features(pairs, described, parity=True).collect()}
    assert set(out) == {(1, 2), (1, 3)} and len(pair_features.PARITY) == 27
    same = out[1, 2]
    assert same.lex_token_set_ratio == 0 and same.lex_dice_tokens == same.lex_lcs_ratio == same.lex_levenshtein_ratio == 1
    assert abs(same.struct_ast_hist_cosine - 1) < 1e-9
    plain = pair_features.pair_features(pairs, described)
    assert len(plain.columns) == 2 + 25


def test_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0), (float("nan"), float("inf"))], "x double, y double")
    rows = {r.feature: r for r in pair_features.feature_metrics(df, ["x", "y"]).collect()}
    assert (rows["x"].n, rows["x"]["mean"], rows["x"]["std"], rows["y"]["median"]) == (2, 2, 1, 4)
    assert [tuple(r) for r in pair_features.sanitized(df, ["x", "y"]).collect()][2] == (0, 1)
    assert {(r.feature1, r.feature2): r.r for r in pair_features.correlations(df.limit(2), ["x", "y"]).collect()}["x", "y"] == 1


def test_catalogue_plans(spark):
    """The candidate joins are equi-joins."""
    for name in ("lsh_pair_filter", "lsh_candidates", "type1_classes"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
