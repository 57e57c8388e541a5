"""The similarity join against all pairs."""

import random

import pytest

from statuta.operators import similar


def sets(seed, n, words=60):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(i, f"b{i % 3}" if i % 11 else None, [f"w{w}" for w in rng.choices(range(words), weights, k=rng.randrange(0, 14))]) for i in range(n)]
    return rows + [(n, "b1", None), (n + 1, "b1", []), (n + 2, *rows[3][1:])]


def slow(a, b, t, measure, within):
    out = []
    for i, p, x in a:
        for j, q, y in b:
            x1, y1 = set(x or []), set(y or [])
            if x1 and y1 and (not within or (p is not None and p == q)):
                s = len(x1 & y1) / (min(len(x1), len(y1)) if measure == "overlap" else len(x1 | y1))
                out += [(i, j, round(s, 9))] if s >= t else []
    return sorted(out)


@pytest.mark.parametrize("measure", similar.MEASURES)
@pytest.mark.parametrize("t, within", [(0.3, False), (0.5, True), (0.8, False), (1.0, False)])
def test_pairs_equal_all_pairs(spark, measure, t, within):
    a, b = sets(1, 150), sets(2, 120)
    frames = [spark.createDataFrame(x, "key long, block string, tokens array<string>").repartition(3) for x in (a, b)]
    got = sorted((r["a"], r["b"], round(r["score"], 9)) for r in similar.similar_pairs(*frames, t, measure, within).collect())
    assert got == slow(a, b, t, measure, within)


def test_few_pairs_are_verified(spark):
    """Sets that share two frequent words: nearly no pair is worth a look."""
    rng = random.Random(3)
    rows = [(i, None, ["the", "of", *(f"x{rng.randrange(4000)}" for _ in range(10))]) for i in range(600)]
    rows += [(1000 + i, None, rows[i][2][:-1] + ["y"]) for i in range(20)]
    df = spark.createDataFrame(rows, "key long, block string, tokens array<string>")
    seen: dict = {}
    got = similar.similar_pairs(df, df, 0.8, "jaccard", seen=seen).where("a < b").count()
    assert got == len([p for p in slow(rows, rows, 0.8, "jaccard", False) if p[0] < p[1]]) >= 20
    assert seen["verified"] <= 0.02 * len(rows) ** 2


def test_bounds_are_checked(spark):
    df = spark.createDataFrame([], "key long, tokens array<string>")
    assert similar.similar_pairs(df, df, 0.5).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(df, df, 0.0)
