from pyspark.sql import functions as F

from echofind.functions import tokens as T
from echofind.operators import normalize

CODE = 'public int add(int a, int b) { if (a > 0) { return a + b; } return "x".length() >= 2 ? 1 : 0; } // end'


def test_columns_agree_with_the_tree(spark):
    sources = [CODE, "", "a", "}{", "for (int i = 0; i < n; i++) { x[i] = i; }", "@Override void f() { g(1.5e3, 'c', true); }", "\"open"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "id int, s string")
    rows = df.select("id", T.categories(F.col("s")).alias("t"), T.syntax(F.col("s")).alias("p")).collect()
    for r in rows:
        assert list(r.t) == list(r.p.token_ids)
        tree = r.p
        assert len(tree.types) == len(tree.depths) == len(tree.parents)
        assert tree.parents[0] is None and all(p is not None and p < k for k, p in enumerate(tree.parents) if k)
        assert all(tree.depths[k] == tree.depths[p] + 1 for k, p in enumerate(tree.parents) if k)


def test_literals_of_any_length(spark):
    """Literals that a backtracking pattern would recurse into, closed and open, and many small ones."""
    long = "x" * 1_000_000
    sources = [f'a = "{long}" + 1;', f'b = "{long}', "c = '" + "\\\\'" * 200_000 + "';", '"' + '\\"' * 300_000 + '" d', '"a" ' * 20_000]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sources)], "id int, s string")
    got = {r.id: (r.n, r.k, r.m) for r in df.select("id", F.size(T.categories(F.col("s"))).alias("n"), F.slice(T.categories(F.col("s")), 1, 6).alias("k"), F.size(T.syntax(F.col("s"))["token_ids"]).alias("m")).collect()}
    assert got[0][:2] == (6, [1, 2, 3, 2, 3, 6]) and got[1][:2] == (3, [1, 2, 3]) and got[3][0] == 2 and got[4][0] == 20_000
    assert all(n == m for n, _, m in got.values())


def test_statistics(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 1], [None, 0, 0, 1, 1]), ([0, 1, 0, 2, 1, 0, 255], [None] * 7)], "t array<int>, p array<int>")
    a, b = df.select(T.count_categories(F.col("t"), 4).alias("h"), T.cyclomatic(F.col("t")).alias("cc"), T.bigrams(F.col("t"), F.col("p")).alias("b"), T.abstracted(F.col("t"), {0: 9, 1: 8}).alias("m"), T.encoded(F.col("t")).alias("e")).collect()
    assert a.h == [1, 2, 1, 1] and a.cc == 3 and a.b == [1, 2, 256 + 3, 256 + 1]
    assert b.h == [3, 2, 1, 0] and b.cc == 5 and b.b == []
    assert b.m == [9, 8, 9, 255, 8, 9, 255] and b.e == [0, 1, 0, 2, 1, 0, 255]


def test_records(spark):
    df = spark.createDataFrame([(1, CODE), (2, "   "), (3, None)], "id int, text string")
    rows = normalize.token_records(df).collect()
    assert [r.id for r in rows] == [1]
    assert rows[0].token_count == len(rows[0].token_ids) and sum(rows[0].ast.histogram) <= rows[0].ast.node_count
    assert len(rows[0].ast.bigrams) == rows[0].ast.node_count - 1
