"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so cosine >= t means a distance of at most eps = sqrt(2 - 2t).
Principal directions come from the moments of all rows. Distinct vectors are sorted by the grid
cells (side eps) of their leading principal coordinates; the sequence is cut into intervals, and
two intervals are only joined if the boxes of their coordinates come within eps. A join of two
intervals halves the longer one, drops provably distant halves and recurses; small ones compare
leading coordinates first and the full vectors, in double precision, last.

Each interval join returns, per vector, its number of links and a spanning link, never the pairs.
Equal vectors are one class with a count. Null or empty vectors, those with null or non-finite
components and zero vectors link with nothing: n_links 0, their own component, kept. Vectors of
different lengths never link. A null vec_id is larger than all others. Repeated rows count as
separate vectors. Ties: a component is named by its smallest vec_id, however often that repeats.
Empty tables give empty results. Columns other than vec_id and embedding are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import NO_ID, attached, connected_components, with_global_index, written
from statuta.llm.simhash import spanning
from statuta.llm.vectors import stacked, unpack, usable, widths

#: Leading principal coordinates for the order and the boxes; rows of an interval; of a leaf join.
LEAD, INTERVAL, LEAF = 12, 4096, 512


def principal_directions(classes: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors (columns, largest first) of the second moments of all rows' unit vectors."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, n, s = np.zeros((width, width)), 0, np.zeros(width)
        for f in frames:
            x = unpack(f["unit"], width)
            m, s, n = m + x.T @ x, s + x.sum(0), n + len(x)
        values = np.concatenate([m.ravel(), s, [n]])
        yield pd.DataFrame({"at": np.arange(len(values)), "value": values})

    total = classes.mapInPandas(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = total.orderBy("at").toPandas()["value"].to_numpy()  # width * (width + 1) + 1 numbers
    n = max(values[-1], 1) if len(values) else 1
    m = values[: width * width].reshape(width, width) / n if len(values) else np.eye(width)
    mean = values[width * width : -1] / n if len(values) else np.zeros(width)
    order, vectors = np.linalg.eigh(m - np.outer(mean, mean))
    return vectors[:, np.argsort(-order)]


def joined(a: np.ndarray, b: np.ndarray, t: float, lead: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of a and b (principal coordinates, unit length) with inner product >= t.

    Blocks of rows whose boxes on the leading coordinates are over eps apart are skipped.
    If same, a is b and only i < j count.
    """
    eps2 = 2 - 2 * t + 1e-9

    def walk(a0: int, a1: int, b0: int, b1: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if same and b1 <= a0 + 1:
            return
        x, y = a[a0:a1, :lead], b[b0:b1, :lead]
        apart = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if apart @ apart > eps2:
            return
        if max(a1 - a0, b1 - b0) > LEAF:
            if a1 - a0 >= b1 - b0:
                mid = (a0 + a1) // 2
                yield from walk(a0, mid, b0, b1)
                yield from walk(mid, a1, b0, b1)
            else:
                mid = (b0 + b1) // 2
                yield from walk(a0, a1, b0, mid)
                yield from walk(a0, a1, mid, b1)
            return
        x, y = x.astype(np.float32), y.astype(np.float32)
        near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T) <= eps2 + 1e-5
        i, j = np.nonzero(near)
        if same:
            keep = j + b0 > i + a0
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)] + a0, j[at : at + (1 << 16)] + b0
            close = np.einsum("ij,ij->i", a[p], b[q]) >= t
            if close.any():
                yield p[close], q[close]

    if len(a) and len(b):
        yield from walk(0, len(a), 0, len(b))


def interval_pairs(placed: DataFrame, lead: int, eps: float) -> DataFrame:
    """Rows (i, j), i <= j, of intervals whose boxes come within eps.

    Boxes meet through the cells they cover on the first coordinate, then all are compared.
    """
    box = placed.groupBy("part").agg(*[f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(lead) for n, f in (("lo", F.min), ("hi", F.max))])
    box = written(box, "epsilon-boxes")
    cells = box.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps))))
    wide = box.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo0") / eps) - 1, F.floor(F.col("hi0") / eps) + 1)))
    a, b = cells.alias("a"), wide.alias("b")
    gap = sum((F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) ** 2 for k in range(lead)), F.lit(0.0))
    close = a.join(b, F.col("a.cell") == F.col("b.cell")).where(gap <= eps * eps + 1e-9)
    return close.select(F.least("a.part", "b.part").alias("i"), F.greatest("a.part", "b.part").alias("j")).distinct()


LINK = "u struct<first:long,id:long>, v struct<first:long,id:long>, links long"


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.col("v")))
    # -0.0 and 0.0 are one number; a digest of the numbers names a class of equal vectors.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = written(rows.withColumn("cls", F.sha2(F.to_json(F.struct("v")), 256)), "epsilon-rows")
    idle = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    held = rows.where("v IS NOT NULL")
    first = F.coalesce(F.min("vec_id"), F.lit(NO_ID)).cast("long")
    classes = held.groupBy("cls").agg(F.count("*").alias("copies"), first.alias("first"), F.any_value("v").alias("v"))
    width = widths(held, "v")
    if not width:
        return idle
    lead, eps = min(LEAD, width), float(np.sqrt(max(2 - 2 * threshold, 1e-12)))

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = stacked(f["v"], width)
            x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            yield pd.DataFrame({"cls": f["cls"], "copies": f["copies"], "first": f["first"], "dim": [len(r) for r in f["v"]], "unit": [r.tobytes() for r in x]})

    units = written(classes.mapInPandas(scale, "cls string, copies long, first long, dim int, unit binary"), "epsilon-units")
    turn = principal_directions(units, width)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = unpack(f["unit"], width) @ turn
            out = f[["cls", "copies", "first", "dim"]].assign(unit=[r.tobytes() for r in x])
            out["lead"] = list(x[:, :lead])
            out["cells"] = list(np.floor(x[:, :lead] / eps).astype(np.int32))
            yield out

    turned = units.mapInPandas(project, "cls string, copies long, first long, dim int, unit binary, lead array<double>, cells array<int>")
    parts = max(1, units.count() // INTERVAL)
    placed = with_global_index(turned, [F.col("dim"), F.col("cells"), F.col("lead"), F.col("cls")], "id", "epsilon-order", parts)
    placed = written(placed.withColumn("part", F.floor(F.col("id") / INTERVAL)), "epsilon-placed")
    pairs = written(interval_pairs(placed, lead, eps), "epsilon-pairs")
    sides = pairs.select("i", "j", F.col("i").alias("part"), F.lit(0).alias("side")).unionAll(
        pairs.where("i <> j").select("i", "j", F.col("j").alias("part"), F.lit(1).alias("side"))
    )
    dealt = sides.join(placed.select("part", "id", "first", "dim", "copies", "unit"), "part").drop("part")

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "id"])
        ids, firsts, copies, dim = (f[c].to_numpy(np.int64) for c in ("id", "first", "copies", "dim"))
        x, n = unpack(f["unit"], width), int((f["side"] == 0).sum())
        same = n == len(f)
        links, label = np.zeros(len(f), np.int64), np.arange(len(f))
        for p, q in joined(x[:n], x if same else x[n:], threshold, lead, same):
            q = q if same else q + n
            like = dim[p] == dim[q]
            p, q = p[like], q[like]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            u, v = label[p], label[q]
            label = spanning(len(f), u, v)[label] if (u != v).any() else label
        some = np.flatnonzero(links)
        ends = [pd.Series([{"first": a, "id": b} for a, b in zip(firsts[k].tolist(), ids[k].tolist())], dtype=object) for k in (some, label[some])]
        return pd.DataFrame({"u": ends[0], "v": ends[1], "links": links[some]})

    found = written(dealt.groupBy("i", "j").applyInPandas(join, LINK), "epsilon-links")
    comps = connected_components(found, "epsilon-stars")
    counts = found.groupBy(F.col("u.id").alias("_id")).agg(F.sum("links").alias("_links"))
    c = placed.select("id", "cls", "copies", "first").join(counts, F.col("id") == F.col("_id"), "left").join(comps, F.struct("first", "id") == F.col("node"), "left")
    links, name = F.coalesce("_links", F.lit(0)) + F.col("copies") - 1, F.nullif(F.coalesce("component.first", "first"), F.lit(NO_ID))
    c = written(c.select("cls", links.cast("long").alias("n_links"), name.alias("component_id"), "copies"), "epsilon-classes")
    out = attached(held.select("vec_id", "cls"), c, "cls", "copies")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionAll(idle)
