"""Exact top-k inner products by no-random-access aggregation of sorted lists.

A block of candidates has one list per component, sorted by value; a query with a positive weight
reads a list from its top, with a negative weight from its bottom. All lists are read in step, to
depths that double from 1 % of the list. Every candidate has a lower bound (unread components count
as the list's worst value) and an upper bound (as the value just reached). Newly read entries raise
the lower bounds, and bounds are looked at when a few candidates and queries tell that a look would
be of use. A query's threshold is the k-th best lower bound, or the k-th best score that it found in
an earlier block, if that is better. Candidates whose upper bound is below the threshold are
outsiders; once at most 2k others are left, or lists end, reading stops for that query, and those
left get their final scores. Lists end before that where a vector's weight is spread evenly over
many components; where few components matter, a small share of the entries is read.

Query blocks meet candidate blocks by a key, so a task holds one block of each. A first round lets
each query block meet one candidate block; the scores it finds are the thresholds that go into the
meetings with all other blocks. The k best of all meetings are ranked at the end.

Vectors null, empty or with null or non-finite components take no part. Every row is a candidate,
and a query of its own if its id is a multiple of `every`, whether its id repeats or is null; a row
never meets itself. Ties go to the smaller vec_id, a null one last. Vectors of different lengths are
scored over the components both have. Bounds are kept in floating point with room for its error, scores are
exact; one beyond 64 bits counts as the largest (smallest) of these. Columns other than vec_id and
embedding are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.common import NO_ID, written
from statuta.llm.vectors import unpack, usable, widths

#: Candidates and queries of a block, and the share of the lists read before the first look at bounds.
CANDIDATES, QUERIES, FIRST = 8192, 512, 0.01


def quantised(v: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double, as longs."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


class Lists:
    """The sorted lists of a block of candidates and the bounds of its candidates for some queries (rows)."""

    def __init__(self, candidates: np.ndarray, queries: np.ndarray) -> None:
        self.values, self.n = candidates, len(candidates)
        order = np.argsort(-candidates, axis=0, kind="stable")
        self.sorted = np.take_along_axis(candidates, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[:, None], axis=0)
        self.most, self.least = self.sorted[0], self.sorted[-1]
        self.plus, self.minus = np.maximum(queries, 0), np.minimum(queries, 0)
        self.rows, self.depth = np.arange(self.n), 0  # candidates still read, entries seen by the bounds
        low = self.plus @ self.least + self.minus @ self.most
        self.lower = np.repeat(low[:, None], self.n, axis=1)

    def entries(self, rows: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Which components of the candidates are read between two depths, from the top and from the bottom."""
        p = self.place[rows]
        return (p >= start) & (p < stop), (p < self.n - start) & (p >= self.n - stop)

    def gaps(self, rows: np.ndarray, depth: int, queries: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Upper less lower bounds after `depth` entries: what is unread can be as good as the frontier."""
        top, bottom = self.entries(rows, 0, depth)
        up = self.plus[queries] * (self.sorted[depth - 1] - self.least)
        down = self.minus[queries] * (self.sorted[self.n - depth] - self.most)
        return up @ (~top).T.astype(up.dtype) + down @ (~bottom).T.astype(up.dtype)

    def gains(self, rows: np.ndarray, start: int, stop: int, queries: slice | np.ndarray = slice(None)) -> np.ndarray:
        """What the entries read between two depths add to lower bounds."""
        top, bottom = self.entries(rows, start, stop)
        v = self.values[rows]
        return self.plus[queries] @ np.where(top, v - self.least, 0).T + self.minus[queries] @ np.where(bottom, v - self.most, 0).T

    def advance(self, depth: int) -> np.ndarray:
        """Bring the lower bounds to a depth by the newly read entries; returns upper bounds."""
        self.lower += self.gains(self.rows, self.depth, depth)
        self.depth = depth
        return self.lower + self.gaps(self.rows, depth) if depth < self.n else self.lower

    def promising(self, depth: int, floor: np.ndarray, k: int) -> bool:
        """Whether a look at this depth is worth it: by some candidates and queries, half of all could go."""
        rows = self.rows[:: max(1, len(self.rows) // 256)]
        some = slice(None, None, max(1, len(floor) // 64))
        at = np.searchsorted(self.rows, rows)
        lower = self.lower[some][:, at] + self.gains(rows, self.depth, depth, some)
        upper = lower + self.gaps(rows, depth, some)
        good = min(len(rows), max(1, k * len(rows) // self.n))
        threshold = np.maximum(floor[some], np.partition(lower, len(rows) - good, axis=1)[:, len(rows) - good])
        return (upper >= threshold[:, None]).mean() < 0.5

    def keep(self, rows: np.ndarray, queries: np.ndarray) -> None:
        """Go on with some of the candidates and queries (masks)."""
        self.rows, self.lower = self.rows[rows], self.lower[queries][:, rows]
        self.plus, self.minus = self.plus[queries], self.minus[queries]


def nra(queries: np.ndarray, candidates: np.ndarray, k: int, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(query, candidate) index pairs that can be among each query's k best, and the share of entries read.

    own[q] is the candidate that is the query itself, or -1; floor[q] is a score that k others are
    known to have, or -inf. Ties with the threshold are all kept.
    """
    n, most = len(candidates), float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * candidates.shape[1]
    kind = np.float32 if 8 * most < 1 << 24 else np.float64
    room = 0.0 if 8 * most < 1 << 53 else 64.0 * candidates.shape[1] * most * 2.0**-53
    lists = Lists(candidates.astype(kind), queries.astype(kind))
    mine = np.flatnonzero(own >= 0)
    lists.lower[mine, own[mine]] = -np.inf
    asking, floor, weights = np.arange(len(queries)), floor.astype(np.float64), np.count_nonzero(queries, axis=1)
    out_q, out_c, read, depth = [], [], 0, max(1, int(np.ceil(FIRST * n)))
    while len(asking):
        depth = min(depth, n)
        if depth < n and not lists.promising(depth, floor, k):
            depth *= 2
            continue
        upper, threshold = lists.advance(depth), floor
        if len(lists.rows) >= k:
            threshold = np.maximum(floor, np.partition(lists.lower, len(lists.rows) - k, axis=1)[:, len(lists.rows) - k] - room)
        alive = (upper + room >= threshold[:, None]) & (upper > -np.inf)
        done = (alive.sum(1) <= 2 * k) | (depth == n)
        q, c = np.nonzero(alive[done])
        out_q.append(asking[done][q])
        out_c.append(lists.rows[c])
        read += depth * int(weights[asking[done]].sum())
        floor, asking = threshold[~done], asking[~done]
        if len(asking):
            lists.keep(alive[~done].any(0), ~done)  # outsiders of every query left are read no further
        depth *= 2
    q, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c))
    return q, c, read / max(1, n * int(weights.sum()))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows, as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 1 << 62:
        return (q * c).sum(1)
    whole = (sum(map(int.__mul__, x, y)) for x, y in zip(q.tolist(), c.tolist()))
    return np.array([max(-NO_ID - 1, min(NO_ID, s)) for s in whole], np.int64)


def block_best(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best of one block of candidates, as indices."""
    order = np.argsort(c_rows)
    spot = np.minimum(np.searchsorted(c_rows[order], q_rows), len(order) - 1)
    own = np.where(c_rows[order][spot] == q_rows, order[spot], -1)
    i, j, _ = nra(q, c, k, own, floor)
    score = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        score[s] = exact_scores(q[i[s]], c[j[s]])
    rank = np.lexsort((c_rows[j], c_ids[j], ~score, i))
    i, j, score = i[rank], j[rank], score[rank]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], score[best]


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id `every` divides."""
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    n, width = rows.count(), max(1, widths(rows, "v"))
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-n // (QUERIES * every)))

    def pack(frames):
        for f in frames:
            out = np.zeros((len(f), width), np.int64)
            for o, r in zip(out, f["v"]):
                o[: len(r)] = r
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "row": f["row"], "v": [o.tobytes() for o in out]})

    packed = written(rows.mapInPandas(pack, "vec_id long, row long, v binary"), "topk-packed")
    candidates = packed.select("row", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    asked = packed.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.select("row", F.col("vec_id").alias("id"), "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).alias("grp"))

    def best(f: pd.DataFrame) -> pd.DataFrame:
        asks = f["asks"].to_numpy() == 1
        q, c = f[asks], f[~asks]
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "query_id": [], "row": [], "id": [], "score": []}, dtype=np.int64)
        rows, ids = ([x[name].to_numpy(np.int64) for x in (q, c)] for name in ("row", "id"))
        floor = q["floor"].to_numpy(np.float64)
        i, j, score = block_best(rows[0], unpack(q["v"], width, np.int64), np.where(np.isnan(floor), -np.inf, floor), rows[1], ids[1], unpack(c["v"], width, np.int64), k)
        return pd.DataFrame({"query": rows[0][i], "query_id": ids[0][i], "row": rows[1][j], "id": ids[1][j], "score": score})

    def met(queries: DataFrame, first: bool) -> DataFrame:
        """Meetings of query blocks with their first candidate block, or with all others."""
        home = F.pmod("grp", F.lit(blocks))
        every_block = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
        at = home if first else F.explode(F.filter(every_block, lambda b: b != home))
        every_group = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
        to = F.filter(every_group, lambda g: (F.pmod(g, F.lit(blocks)) == F.col("block")) == F.lit(first))
        c = candidates.select("row", "id", "v", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("asks"), "block", F.explode(to).alias("grp"))
        q = queries.select("row", "id", "v", "floor", F.lit(1).alias("asks"), "grp", at.alias("block")).select(c.columns)
        return c.unionAll(q).groupBy("block", "grp").applyInPandas(best, "query long, query_id long, row long, id long, score long")

    found = written(met(queries.withColumn("floor", F.lit(None).cast("double")), True), "topk-first")
    if blocks > 1:
        # The k-th best score of the first block: its queries have k others at least that good.
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row"))
        floors = found.withColumn("_r", rank).where(F.col("_r") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("floor"))
        exact = F.when(F.abs("floor") < float(1 << 53), F.col("floor"))
        found = found.unionAll(met(queries.join(floors, "row", "left").withColumn("floor", exact), False))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.nullif("id", F.lit(NO_ID)).alias("vec_id"), "score")
