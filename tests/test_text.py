import random

import pytest
from pyspark.sql import functions as F

from echofind.functions import text as X
from echofind.operators import normalize


def bare(source):
    """A plain state machine."""
    out, i, n = [], 0, len(source)
    while i < n:
        c = source[i]
        if c in "\"'":
            j = i + 1
            while j < n and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            out.append(source[i : j + 1])
            i = j + 1
        elif source.startswith("//", i):
            while i < n and source[i] != "\n":
                i += 1
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append("\n" * source.count("\n", i, end))
            i = end
        else:
            out.append(c)
            i += 1
    return "".join(out)


def spaced(source):
    lines, out = source.replace("\t", " ").replace("\r", " ").split("\n"), []
    for line in lines:
        line = line.lstrip(" ")
        while "  " in line:
            line = line.replace("  ", " ")
        if line:
            out.append(line)
    return "\n".join(out)


def test_literal_cases(spark):
    cases = [
        ("int x = 5; // this is a comment\nint y = 10;", "int x = 5; \nint y = 10;"),
        ('String s = "// not a comment"; // real comment', 'String s = "// not a comment"; '),
        ("char c = '/'; // comment", "char c = '/'; "),
        ('String s = "hello \\"world\\""; // comment', 'String s = "hello \\"world\\""; '),
        ("a /* b\nc */ d", "a \n d"),
    ]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k int, s string")
    got = dict(df.select("k", X.remove_comments(F.col("s"))).collect())
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_strings(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("\"'/*\\\n ab;\t\r") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    rows = df.select("k", X.remove_comments(F.col("s")).alias("b"), X.normalize_whitespace(F.col("s")).alias("w")).collect()
    for r in rows:
        assert r.b == bare(texts[r.k])
        assert r.w == spaced(texts[r.k])


def test_long_text(spark):
    text = "x = 'y'; /* " + "z\n" * 200_000 + "*/ done"
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(X.normalize_source(F.col("s"))).first()[0] == "x = 'y'; \ndone"


def test_impact_and_nulls(spark):
    df = spark.createDataFrame([(1, "int x = 5;\n\n\n// comment\nint y = 10;\n"), (2, ""), (3, None)], "id int, text string")
    rows = {r.id: r for r in normalize.impact(df).collect()}
    assert (rows[1].original_lines, rows[1].normalized_lines, rows[1].lines_removed) == (6, 2, 4)
    assert rows[2].original_lines == rows[2].normalized_tokens == 0
    assert rows[3].normalized_lines is None
    assert normalize.impact_summary(normalize.impact(df)).first().snippets == 3
