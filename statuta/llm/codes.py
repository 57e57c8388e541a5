"""Compression of vectors to codes: product quantisation fitted on distinct parts with weights.

Components become integers floor(scale * x), vectors are cut into equal consecutive parts. Equal parts of one position
are counted into one distinct row with a weight, so what the rounds of Lloyd's method go over, and what meets in any
shuffle by part, is as large as the number of different parts, however often one repeats. Each task returns one sum for
each entry of a codebook; these are summed in Spark, and only the codebooks (numbers of a vector times entries)
reach the driver. The final codes and errors of the distinct parts are joined back to the vectors. Vectors that are
equal as a whole are one row until the very end, so a vector of a third of the table is coded once.

Vectors that are null, empty or hold null or non-finite components are dropped. The width is that of the kept
vector of the smallest vec_id; vectors of another width get null codes and errors, and so do all if parts don't
divide the width. A null vec_id is kept and comes last; repeated rows count each; of start vectors of one vec_id the
smaller vector comes first. With fewer vectors than entries a codebook has one entry a vector. An empty table gives an
empty result. Components beyond a long stand at its ends; an error or sum that no long can hold is null. Null
labels are one label. Columns other than vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.centroids import EXACT, LONG, WIDE, matrix
from statuta.llm.common import attached, written
from statuta.llm.vectors import usable

#: Numbers of the table of squared differences that one slice of rows makes.
TABLE = 1 << 20

Codebooks = list[list[list[int]]]


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry; ties go to the lower index."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), object if object in (x.dtype, book.dtype) else np.int64)
    step = max(1, TABLE // book.size)
    for at in range(0, len(x), step):
        d = ((x[at : at + step, None, :] - book[None]) ** 2).sum(2)
        code[at : at + step] = d.argmin(1)
        far[at : at + step] = d.min(1)
    return code, far


def tables(books: Codebooks) -> list[np.ndarray]:
    big = any(abs(x) > EXACT for b in books for e in b for x in e)
    return [np.array(b, object if big else np.int64) for b in books]


def by_position(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, numbers of its rows, their parts)"""
    at, x = np.asarray(batch.column("pos")), matrix(batch.column("part"), size)
    for p in np.unique(at).tolist():
        own = np.flatnonzero(at == p)
        yield p, own, x[own]


def moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over weighted distinct parts: componentwise floors of means; unused entries stay."""
    size, held = len(books[0][0]), tables(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, int], int] = {}
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            weights = np.asarray(b.column("weight")).astype(object)
            for p, own, x in by_position(b, size):
                code, _ = nearest_entries(x, held[p])
                w = weights[own]
                for j in np.unique(code).tolist():
                    used = code == j
                    count[p, j] = count.get((p, j), 0) + int(w[used].sum())
                    new = (x[used].astype(object) * w[used, None]).sum(0)
                    total[p, j] = [a + int(s) for a, s in zip(total.get((p, j), [0] * size), new)]
        if count:
            yield pa.RecordBatch.from_pydict({
                "pos": pa.array([p for p, _ in count], pa.int32()), "entry": pa.array([j for _, j in count], pa.int32()),
                "n": pa.array(list(count.values()), pa.int64()), "total": pa.array([[str(s) for s in total[k]] for k in count], pa.list_(pa.string())),
            })

    parts = distinct.select("pos", "part", "weight").mapInArrow(sums, "pos int, entry int, n long, total array<string>")
    added = parts.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d].cast(WIDE)).alias(f"s{d}") for d in range(size)])
    out = [[list(e) for e in b] for b in books]
    for r in added.collect():  # entries of all positions at most
        out[r["pos"]][r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(size)]
    return out


def coded(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """pos, part, weight with code (index of the nearest entry) and far (squared distance)."""
    size, held = len(books[0][0]), tables(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, object)
            for p, own, x in by_position(b, size):
                code[own], far[own] = nearest_entries(x, held[p])
            held_far = pa.array([d if d <= LONG else None for d in far.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int32()), held_far], [*b.schema.names, "code", "far"])

    return distinct.mapInArrow(assign, "pos int, part array<bigint>, weight long, code int, far long")


def start_vectors(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids."""
    return [list(r["q"]) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()]


def quantised(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes array<int>, error of every kept vector; the codebooks by part, entry and position)."""
    v = F.col("embedding").cast("array<double>")
    kept = embeddings.select("vec_id", "label", F.when(usable(v), v).alias("v")).where("v IS NOT NULL")
    q = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = written(kept.select("vec_id", "label", q.alias("q")), "codes-vectors")
    first = start_vectors(rows, 1)
    width = len(first[0]) if first else 0
    fits = bool(width) and width % parts == 0
    other = rows.where((F.size("q") != width) if fits else F.lit(True)).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    if not fits:
        return other, []
    size = width // parts
    held = rows.where(F.size("q") == width)
    seeds = start_vectors(held, entries)
    books = [[s[p * size : (p + 1) * size] for s in seeds] for p in range(parts)]
    whole = written(held.groupBy("q").agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "codes-whole")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("q", p * size + 1, F.lit(size)))).alias("pos", "part")
    distinct = written(whole.select("copies", cut).groupBy("pos", "part").agg(F.sum("copies").alias("weight")), "codes-distinct")
    for _ in range(rounds):
        books = moved(distinct, books)
    # Back to the distinct vectors. A part that very many of them share is looked up where they are.
    facts = coded(distinct, books).select(F.struct("pos", "part").alias("key"), "code", "far", "weight")
    named = whole.select("id", cut).select("id", F.struct("pos", "part").alias("key"))
    met = attached(named, written(facts, "codes-parts"), "key", "weight")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct(F.col("key.pos").alias("p"), "code"))), lambda x: x["code"])
    error = F.when(F.count("far") == parts, F.sum(F.col("far").cast(WIDE))).cast(WIDE)
    done = met.groupBy("id").agg(in_order.alias("codes"), F.when(error <= F.lit(LONG), error).cast("long").alias("error"))  # a row a part
    done = written(done.join(whole, "id").select("q", "codes", "error", "copies"), "codes-done")
    return attached(held, done, "q", "copies").select("vec_id", "label", "codes", "error").unionByName(other), books


def codebook_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def code_report(embeddings: DataFrame, **options: int) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every kept vector."""
    vectors, books = quantised(embeddings, **options)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = written(vectors.select("vec_id", name.alias("name"), code.alias("code"), "error"), "codes-rows")
    total = F.sum(F.col("error").cast(WIDE))
    sums = rows.groupBy("name").agg(F.when(total <= F.lit(LONG), total).cast("long").alias("label_error"), F.count("*").alias("n"))
    out = attached(rows, written(sums, "codes-labels"), "name", "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
