import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words int, id string, key string, `rows.x` int"


def words(rng, n, vocabulary=400):
    return " ".join(f"{'abcdefghij'[k % 10]}{k}x" for k in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), among columns whose names operators use inside."""

    def build(rows, parts=2):
        full = [(d, t, "en", "src", None if t is None else len(t), None, None, "i", "k", 1) for d, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, short, empty, null, long and repeated rows."""
    rng = random.Random(12)
    base = words(rng, 130)
    rows = [(k, words(rng, rng.randrange(1, 160))) for k in range(20, 60)]
    rows += [(10, base), (11, base), (4, base)]
    for k in range(61, 75):
        w = base.split()
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    passage = words(rng, 55)
    rows += [(k, f"{words(rng, 20)}\n{passage}  {words(rng, 8)}") for k in (80, 81, 82)]
    rows += [(90, ""), (91, None), (92, "   \t\n"), (93, "one"), (94, "One"), (95, "a b c"), (96, "same same " * 60), (97, "same same " * 70)]
    rows += [(98, words(rng, 9000)), (None, base), (None, None), (99, passage), (99, passage)]
    rows += [(100, "Ünïcödé text mit ßonderzeichen   und Wörtern " * 12), (101, "🙂 emoji 😀 text " * 5)]
    return rows
