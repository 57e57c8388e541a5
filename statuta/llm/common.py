"""Shared pieces of the training-data operators: tables, ranks, hot keys, components, worker memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.session import dropped, written

__all__ = ["NO_ID", "attached", "collected", "connected_components", "dropped", "fresh", "give_back", "grouped_prefix", "joined_to", "partitions_of", "prefix_sums", "small", "small_table", "table", "text_parts", "with_global_index", "written", "written_by_batches"]

#: Stands for a missing doc_id inside operators: it is larger than every other id.
NO_ID = (1 << 63) - 1
#: Rows of one key past which a join no longer leaves the key to one task.
HOT = 1 << 20
#: Rows (of a few numbers each) up to which a table is sent to every task instead of shuffling what it meets.
FEW = 1 << 20
#: Rows of an Arrow batch where texts go to Python for a written table.
BATCH_ROWS = 1000
#: Bytes of text that a function takes from an Arrow batch at a time.
PART = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_parts(batch: pa.RecordBatch, column: str = "text", most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each (or one row): batches are bounded in
    bytes by the session, and what a function makes of a slice is bounded by this."""
    text = batch.column(column)
    sizes = [0 if n is None else n for n in pa.compute.binary_length(text).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def written_by_batches(df: DataFrame, tag: str) -> DataFrame:
    """written() with Arrow batches of at most BATCH_ROWS rows: what a task and its Python worker hold of texts at a
    time follows this number. The session's own setting is put back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        return written(df, tag)
    finally:
        conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the machine. Workers outlive their tasks and wait for the next ones beside those
    that run; what they no longer use would count against the executor all that time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def partitions_of(df: DataFrame) -> int:
    """Number of input splits: follows the bytes to read, so it scales bucket counts."""
    return max(1, df.rdd.getNumPartitions())


def collected(spark: SparkSession) -> None:
    """Let the driver find out which shuffles nothing refers to any more: their files go from the executors' disks now,
    not when the driver's memory happens to fill. What its Python has freed goes back, too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()


def with_global_index(df: DataFrame, order: list, name: str, tag: str, parts: int) -> DataFrame:
    """Add a gapless 0-based rank in the given total order without a single-task window.

    A range shuffle sorts; the written table fixes which row is where; only one count per
    partition is prefix-summed.
    """
    ranged = (
        df.repartitionByRange(max(1, parts), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = written(ranged, tag)
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row a range partition
        .withColumn(name, (F.col("_before") + local).cast("long"))
        .drop("_at", "_part", "_before")
    )


def prefix_sums(sums: DataFrame, group: list[str], at: str, size: str, name: str, span: int = 4096) -> DataFrame:
    """Add the sum of `size` before each row of its group, in the order of the whole numbers `at` (unique in a group).

    Two levels: stretches of `span` numbers are summed, the sums summed up, so that no task sees a
    group's rows, only its stretches.
    """
    before = lambda *keys: Window.partitionBy(*keys)
    up_to = lambda w, o: w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("_stretch", F.floor(F.col(at) / span))
    high = cut.groupBy(*group, "_stretch").agg(F.sum(size).alias("_s"))
    high = high.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.col("_stretch").alias("_st"),
                       F.coalesce(F.sum("_s").over(up_to(before(*group), "_stretch")), F.lit(0)).alias("_high"))
    low = cut.withColumn("_low", F.coalesce(F.sum(size).over(up_to(before(*group, "_stretch"), at)), F.lit(0)))
    on = [low[g].eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(group)] + [low["_stretch"] == F.col("_st")]
    return low.join(high, on).withColumn(name, F.col("_high") + F.col("_low")).drop("_stretch", "_st", "_low", "_high", *[f"_h{i}" for i in range(len(group))])


def grouped_prefix(df: DataFrame, group: list[str], order: list[str], size: str, salts: int, name: str) -> DataFrame:
    """Running sum of `size` before each row, per group in the order of `order`.

    `order` starts with a 64-bit hash, whose top bits deal a group over `salts` slices; slices
    hold a bounded share of even the hottest group, and only one sum per slice is prefix-summed.
    """
    slices = df.withColumn("_slice", F.floor((F.shiftrightunsigned(F.col(order[0]), 33)) * F.lit(salts) / F.lit(1 << 31)).cast("int"))
    # The hash is signed, its unsigned top bits are not in its order; any fixed order does.
    sums = prefix_sums(slices.groupBy(*group, "_slice").agg(F.sum(size).alias("_s")), group, "_slice", "_s", "_base")
    bases = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_slice").alias("_sl"), "_base")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = slices.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    on = [rows[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [rows["_slice"] == F.col("_sl")]
    out = rows.join(bases, on)
    return out.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_slice", "_in", "_base", "_sl", *[f"_g{i}" for i in range(len(group))])


def attached(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the facts of their key; facts has each key once, and `count` says how many rows have it.

    Keys of over HOT rows are at most one in HOT of the rows, so theirs are broadcast and their rows
    stay where they are; the others meet by a shuffle.
    """
    most = facts.agg(F.max(count)).first()[0] or 0
    lean = facts.drop(count)
    if most <= HOT:
        return rows.join(lean, key)
    hot = F.broadcast(facts.where(F.col(count) > HOT).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(F.col(count) <= HOT).drop(count), key))


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most FEW rows; else what it meets is shuffled."""
    return F.broadcast(df) if df.count() <= FEW else df


def small_table(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table like small(), its rows counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count("*").alias("n")), tag)
    return F.broadcast(out) if seen.get["n"] <= FEW else out


def least_neighbour(both: DataFrame, rows: int) -> DataFrame:
    """both (u, v) with m, the smallest of u and its neighbours. Hubs keep their rows where they are."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    if rows <= HOT:
        return both.join(least.drop("_n"), "u")
    return attached(both, written(least, "components-least"), "u", "_n")


def _edges_written(edges: DataFrame, tag: str) -> tuple[DataFrame, tuple]:
    """edges as a written table; their number and a sum of their hashes, counted while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), tag)
    return out, (seen.get["n"], seen.get["h"])


def joined_to(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (u, v): known components (node, component) as stars, and further links between their nodes."""
    return parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(links)


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """Rows (node, component) for a graph of edges (u, v); component is the smallest node.

    Nodes are of any ordered type: a struct carries facts of its node along, so that no join on the
    component is needed to name it. Alternating large-star and small-star steps: every step is one
    minimum per node and one join, so no neighbourhood is ever gathered; each round is written, so
    lineage stays short, and the round before is deleted. A caller that adds links to known components
    gives these as stars (rows of an earlier result) instead of all links so far: fewer rounds are left.
    """
    e, now = _edges_written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    before = None
    while now != before:
        before = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbour(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node now points at smaller ones only.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new, now = _edges_written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        dropped(e)
        e = new
        both = large = low = small = None
        collected(e.sparkSession)  # a round leaves half a dozen shuffles
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())


def fresh(df: DataFrame) -> Column:
    """All columns of df as one struct, beside which other columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
