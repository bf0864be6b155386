"""The forms of joins that large tables take, on small ones: shuffles in place of sent tables, hot keys dealt out."""

import random

import pytest

from echofind.llm import recompress, setsketch, spread

from . import brute
from .test_documents import first_rows, known


@pytest.fixture
def large(monkeypatch):
    """No table is small enough to be sent, and every key with two rows is hot."""
    monkeypatch.setattr(setsketch, "SENT", -1)
    monkeypatch.setattr(setsketch, "BROADCAST_IDS", -1)
    monkeypatch.setattr(recompress, "BROADCAST_IDS", -1)
    monkeypatch.setattr(spread, "LEAST", 1)
    monkeypatch.setattr(spread, "PARTS", 1 << 40)


def test_near_duplicates_joined(make, corpus, large):
    out = setsketch.linked(make(corpus))
    assert out.count() == len(corpus)
    assert first_rows(out, "n_shingles", "component_id", "kept") == brute.near(known(corpus))
    assert [tuple(r)[2:] for r in out.where("doc_id is null").collect()] == [(None, True)] * 2


def test_repeats_joined(make, corpus, large):
    out = recompress.deduplicated(make(corpus))
    assert out.count() == len(corpus)
    assert first_rows(out, "n_words", "n_removed", "kept_sha256") == {d: tuple(r) for d, *r in brute.repeats(known(corpus))}


def test_hot_keys(spark, large):
    big = spark.createDataFrame([(k % 3 if k % 7 else None, k) for k in range(60)], "k int, v int")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "d")], "k int, w string")
    from pyspark.sql import functions as F

    for how in ("inner", "left"):
        want = sorted(big.join(small, ["k"], how).collect(), key=str)
        assert sorted(spread.joined(big, small, ["k"], F.col("v"), how=how).collect(), key=str) == want
    assert spread.joined(big.limit(0), small, ["k"], F.col("v")).count() == 0


def test_links_just_above_the_bound(make):
    """Pairs planted between 0.75 and 0.80, and below 0.75, each apart from all others."""
    rng = random.Random(31)
    rows = []
    for k in range(600):
        base = [f"p{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 260))]
        copy, n = list(base), len(base) - 4
        # a changed word takes five shingles from both sides: similarity (n - 5c) / (n + 5c)
        changed = max(1, int(n * (0.25 if k % 3 else 0.33) / (1.75 if k % 3 else 1.67) / 5))
        for at in rng.sample(range(5, len(base) - 5, 6), changed):
            copy[at] = f"new{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    near, close = {}, 0
    for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(s), shingles(t)
        linked = 100 * len(x & y) >= 75 * len(x | y)
        close += linked and 100 * len(x & y) < 80 * len(x | y)
        near |= {a: a, b: a if linked else b}
    assert close > 300
    assert {r.doc_id: r.component_id for r in setsketch.linked(make(rows, 4)).collect()} == near
