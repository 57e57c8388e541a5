"""Centroid clustering by Lloyd's rounds whose assignment is a partial-distance search.

Components become integers floor(scale * x); all arithmetic on them is exact. One pass over all rows takes the variance of
every dimension. An assignment adds up squared differences over the dimensions of highest variance first: the first block
names each vector's most promising centroid, whose distance is finished and is the best so far; every other centroid is
taken block by block for those vectors only whose partial distance isn't strictly above their best, and what survives all
blocks is compared in full (ties: smaller number). Each task returns one sum a centroid; these few rows are summed
in Spark and only the centroids (k times width numbers) reach the driver.

Vectors that are null, hold null or non-finite components or have another number of components are not kept and not
returned. A null vec_id is kept and assigned; it comes last among the seeds. Repeated rows count each; of seeds of one vec_id
the smaller vector comes first. With fewer than k kept vectors each one seeds a centroid; an empty table gives an empty
result. Components beyond a long stand at its ends; a distance or sum that no long can hold is null. Columns other than
vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from statuta.llm.common import written
from statuta.llm.vectors import usable

#: Dimensions added up before centroids are abandoned; numbers of a slice's table of first partial distances.
BLOCK, TABLE = 8, 1 << 20
#: Up to this size of components squares of 64 differences fit in 64 bits; beyond it Python's whole numbers are used.
EXACT = 1 << 27
LONG = (1 << 63) - 1
WIDE = DecimalType(38, 0)


def integer_vectors(embeddings: DataFrame, scale: int, width: int) -> DataFrame:
    """vec_id and q, the vector's components as floor(scale * x), of the vectors that are kept."""
    v = F.col("embedding").cast("array<double>")
    kept = embeddings.select("vec_id", F.when(usable(v) & (F.size(v) == width), v).alias("v")).where("v IS NOT NULL")
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("q"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` whole numbers as a matrix; of Python's numbers if squares of 64 bits could overflow."""
    x = np.asarray(column.flatten()).reshape(-1, width)
    return x.astype(object) if len(x) and max(int(x.max()), -int(x.min())) > EXACT else x


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, counted: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties go to the smaller number.

    order: the dimensions, highest variance first. counted: gets the number of squared differences that were taken.
    """
    wide = x.dtype == object or centroids.dtype == object
    x, c = x[:, order], centroids[:, order]
    width, first = len(order), min(BLOCK, len(order))
    number = np.zeros(len(x), np.int64)
    best = np.zeros(len(x), object if wide else np.int64)
    taken = 0
    for at in range(0, len(x), max(1, TABLE // (len(c) * first))):
        some = x[at : at + max(1, TABLE // (len(c) * first))]
        rows = np.arange(len(some))
        partial = ((some[:, None, :first] - c[None, :, :first]) ** 2).sum(2)
        lead = partial.argmin(1)
        rest = some[:, first:] - c[lead, first:]
        least, name = partial[rows, lead] + (rest * rest).sum(1), lead.astype(np.int64)
        taken += partial.size * first + rest.size
        for j in range(len(c)):
            live = np.flatnonzero((lead != j) & (partial[:, j] <= least))
            so_far = partial[live, j]
            for a in range(first, width, BLOCK):
                d = some[live, a : a + BLOCK] - c[j, a : a + BLOCK]
                taken += d.size
                so_far = so_far + (d * d).sum(1)
                on = so_far <= least[live]
                live, so_far = live[on], so_far[on]
            won = (so_far < least[live]) | (name[live] > j)
            least[live[won]], name[live[won]] = so_far[won], j
        number[at : at + len(some)], best[at : at + len(some)] = name, least
    if counted is not None:
        counted.append(taken)
    return number, best


def dimensions_by_variance(kept: DataFrame, width: int) -> np.ndarray:
    """Numbers of the dimensions, highest variance first: from one pass over all rows. Only the order follows from it."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, squares = 0, np.zeros(width), np.zeros(width)
        for b in batches:
            x = np.asarray(b.column("q").flatten()).reshape(-1, width).astype(np.float64)
            if len(x):
                m = x.mean(0)
                squares += ((x - m) ** 2).sum(0) + (m - mean) ** 2 * (n * len(x) / (n + len(x)))
                n, mean = n + len(x), mean + (m - mean) * (len(x) / (n + len(x)))
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "mean": mean, "squares": squares})

    parts = kept.select("q").mapInArrow(moments, "at int, n long, mean double, squares double")
    # Sums of squares about the mean of all, from those about each task's mean.
    total = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum("squares") + F.sum(F.col("n") * F.col("mean") ** 2) - F.sum("n") * total**2
    rows = parts.groupBy("at").agg(spread.alias("s")).collect()  # one a dimension
    return np.array([r["at"] for r in sorted(rows, key=lambda r: (-r["s"], r["at"]))], np.int64)


def as_table(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(x) > EXACT for c in centroids for x in c)
    return np.array(centroids, object if big else np.int64)


def assigner(centroids: list[list[int]], order: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    table, width = as_table(centroids), len(order)

    def assign(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = matrix(batch.column("q"), width)
        return x, *nearest(x, table, order)

    return assign


def moved(kept: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round: componentwise floors of their vectors' means; empty ones stay."""
    assign, k, width = assigner(centroids, order), len(centroids), len(order)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * width for _ in range(k)]
        for b in batches:
            x, number, _ = assign(b)
            for j in np.unique(number).tolist():
                own = x[number == j]
                count[j] += len(own)
                total[j] = [a + int(s) for a, s in zip(total[j], own.sum(0))]
        some = [j for j in range(k) if count[j]]
        if some:
            yield pa.RecordBatch.from_pydict(
                {"cluster": pa.array(some, pa.int32()), "n": pa.array([count[j] for j in some], pa.int64()), "total": pa.array([[str(s) for s in total[j]] for j in some], pa.list_(pa.string()))}
            )

    parts = kept.select("q").mapInArrow(sums, "cluster int, n long, total array<string>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d].cast(WIDE)).alias(f"s{d}") for d in range(width)])
    out = list(centroids)
    for r in added.collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    return out


def digest(numbers: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def clustered(embeddings: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vectors with vec_id, q, cluster and distance; the final centroids).

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`. The vectors lie in a written table.
    """
    kept = written(integer_vectors(embeddings, scale, width), "centroids-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["q"]) for r in kept.orderBy(hashed.asc_nulls_last(), "q").limit(k).select("q").collect()]
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("cluster int, distance long").fields])
    if not centroids:
        return kept.sparkSession.createDataFrame([], StructType([StructField(f.name, f.dataType) for f in schema])), []
    order = dimensions_by_variance(kept, width)
    for _ in range(rounds):
        centroids = moved(kept, centroids, order)
    assign = assigner(centroids, order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, number, best = assign(b)
            far = pa.array([d if d <= LONG else None for d in best.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int32()), far], [*b.schema.names, "cluster", "distance"])

    return kept.mapInArrow(place, schema), centroids


def cluster_report(embeddings: DataFrame, **options: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    vectors, centroids = clustered(embeddings, **options)
    placed = written(vectors.select("vec_id", "cluster", "distance"), "centroids-placed")
    far = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("s")).collect()  # k rows at most
    total = sum(r["s"] for r in far) if all(r["s"] is not None for r in far) else None
    fits = lambda s: int(s) if s is not None and s <= LONG else None
    facts = [(r["cluster"], fits(r["s"]), fits(total), digest(centroids[r["cluster"]])) for r in far]
    facts = placed.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
