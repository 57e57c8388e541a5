"""Joins of token sets by similarity, without all pairs.

Tokens are put in one order, rarest first. For a pair to reach the bound, the smaller set must share one of its first
n - ceil(t * n) + 1 tokens, so only these of the smaller set meet the larger sets' tokens (overlap), or the first tokens of both
(Jaccard). A meeting that comes too late in either order is none. What is left is verified on whole sets. A token that very many sets hold
comes last in every order, so it is rarely among the first; within a block (a brand, a year) only sets of that block meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.kept import light
from statuta.session import written

MEASURES = ("overlap", "jaccard")


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Distinct words of a text that are longer than a few characters, in lower case."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > longer_than))


def _ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9)


def _ordered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (key, block, tokens) with the tokens in the common order."""
    e = rows.select("key", "block", F.explode("tokens").alias("token")).join(light(counts), "token")
    return e.groupBy("key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))


def similar_pairs(
    a: DataFrame, b: DataFrame, threshold: float, measure: str = "overlap", within: bool = False, seen: dict | None = None
) -> DataFrame:
    """(a, b, score): keys of all pairs whose sets have a score of `threshold` (over 0) or more.

    a, b: (key, tokens) and, if within, block: only pairs of equal blocks count (a null block has none). Keys are unique. Scores: shared
    tokens by the smaller set (overlap) or by both together (jaccard). Empty and null sets are in no pair. seen: gets the
    number of pairs that were verified.
    """
    if measure not in MEASURES or not 0 < threshold <= 1:
        raise ValueError("a measure of overlap or jaccard, and a bound over 0, up to 1")
    some = F.col("block") if within else F.lit(0)
    sides = [df.select("key", some.alias("block"), F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0) for df in (a, b)]
    counts = sides[0].select(F.explode("tokens").alias("token")).unionAll(sides[1].select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))
    counts = written(counts, "similar-tokens")
    x, y = (written(_ordered(s, counts), f"similar-{n}").withColumn("n", F.size("tokens")) for s, n in zip(sides, "ab"))
    first = lambda s: s.select("key", "block", "n", F.posexplode("tokens").alias("i", "token"))
    u = first(x).select(F.col("key").alias("a"), "block", "token", F.col("n").alias("n"), F.col("i").alias("i"))
    v = first(y).select(F.col("key").alias("b"), "block", "token", F.col("n").alias("m"), F.col("i").alias("j"))
    n, i, m, j = (F.col(c) for c in "nimj")
    beginning = lambda size, at: at <= size - _ceil(threshold * size)
    if measure == "overlap":
        enough = _ceil(threshold * F.least(n, m))
        met = [u.where(beginning(n, i)).join(v, ["block", "token"]).where(n <= m), u.join(v.where(beginning(m, j)), ["block", "token"]).where(n > m)]
    else:
        enough = _ceil(threshold / (1 + threshold) * (n + m))
        met = [u.where(beginning(n, i)).join(v.where(beginning(m, j)), ["block", "token"]).where((n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9))]
    pairs = reduce(DataFrame.unionAll, [p.where((n - i >= enough) & (m - j >= enough)).select("a", "b") for p in met])
    pairs = written(pairs.distinct(), "similar-pairs")
    if seen is not None:
        seen["verified"] = pairs.count()
    both = pairs.join(x.select(F.col("key").alias("a"), F.col("tokens").alias("_a")), "a").join(y.select(F.col("key").alias("b"), F.col("tokens").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    size = F.least(F.size("_a"), F.size("_b")) if measure == "overlap" else F.size("_a") + F.size("_b") - shared
    return both.select("a", "b", (shared / size).alias("score")).where(F.col("score") >= threshold)
