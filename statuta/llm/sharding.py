"""Shards that each match the mixture, by proportional stratified interleaving. DataFrame operations only.

Rows of a source are ranked in a seeded shuffle (a hash of seed and doc_id); row r of n has the fractional rank
(r + u) / n, where u, from 0 to 1, is a hash of seed and source: every source is spread evenly over the numbers from 0 to 1, and
many sources of few rows don't all meet in the middle. All rows are sorted by fractional rank and cut into shards of equal row counts: law `rows`, counts at most one apart, and of every source each shard holds its
share up to a few rows. Equal texts aren't kept in one shard: a group of copies may be larger than a shard.

No source is ever one task: rows are range-partitioned by source and hash, a rank is the place in the
partition plus the counts of the partitions before, and the second sort is such a range shuffle, too.

Nulls: a null text has no bytes (size 1, checksum of nothing), a null source is a source of its own, sorted last, a null
doc_id hashes as an empty one. Repeated rows take a slot each. Ties of the hash go by doc_id (null last), then by a hash of all
columns (maps and variants left out); equal fractional ranks by source. With fewer rows than shards some shards stay empty; an empty table
gives an empty result. Texts of any length travel whole. Columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from statuta.llm.common import fresh, partitions_of, small, with_global_index, written


def seeded(seed: int, key: Column) -> Column:
    """60 bits of a digest of seed and key as a whole number, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def fractional_ranks(rows: DataFrame, parts: int, seed: int) -> DataFrame:
    """rows (doc, _none, _src, _h, _id, _all) with _rank, _n (rows of the source) and _at (fractional rank)."""
    order = ["_none", "_src", "_h", F.col("_id").asc_nulls_last(), "_all"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(ranged, "shards-by-source").withColumn("_part", F.shiftright("_row", 33))
    # A row for each partition and source: sorted, there are at most as many as partitions and sources together.
    runs = ranged.groupBy("_part", "_none", "_src").agg(F.min("_row").alias("_from"), F.count("*").alias("_c"))
    of = Window.partitionBy("_none", "_src")
    before = F.coalesce(F.sum("_c").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phase = (seeded(seed, F.col("_src")).cast("double") + 0.5) / float(1 << 60)
    runs = runs.select("_part", "_none", "_src", (before - F.col("_from")).alias("_shift"), F.sum("_c").over(of).alias("_n"), phase.alias("_phase"))
    runs = written(runs, "shards-runs")
    j = ranged.join(small(runs), ["_part", "_none", "_src"]).withColumn("_rank", F.col("_row") + F.col("_shift"))
    return j.withColumn("_at", (F.col("_rank").cast("double") + F.col("_phase")) / F.col("_n").cast("double")).drop("_row", "_part", "_shift", "_phase")


def sharded(docs: DataFrame, shards: int = 8, seed: int = 13, source: str = "source", key: str = "doc_id") -> DataFrame:
    """doc (a struct of all columns of docs), shard (from 0) and slot (gapless from 0 in its shard)."""
    known = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    s, k = F.col(f"`{source}`"), F.col(f"`{key}`")
    rows = docs.select(
        fresh(docs).alias("doc"), s.isNull().alias("_none"), F.coalesce(s.cast("string"), F.lit("")).alias("_src"), seeded(seed, k).alias("_h"), k.alias("_id"), F.xxhash64(*known).alias("_all")
    )
    parts = partitions_of(docs)
    ranked = fractional_ranks(rows, parts, seed).select("doc", "_at", "_none", "_src", "_rank")
    placed = with_global_index(ranked, ["_at", "_none", "_src", "_rank"], "_index", "shards-in-order", parts)
    total = max(1, placed.count())
    shard = F.expr(f"(_index * {shards}) div {total}")
    return placed.withColumn("shard", shard.cast("int")).select("doc", "shard", (F.col("_index") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> str:
    """The documents as Parquet, a folder a shard, rows in slot order. Returns the name of the folders' column."""
    name = "shard"
    while name in (c.lower() for c in docs.columns):
        name = f"_{name}"
    placed = sharded(docs, **options).repartitionByRange(partitions_of(docs), "shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


def shard_digests(docs: DataFrame, shards: int = 8, seed: int = 13) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Only sizes and checksums travel."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    light = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharded(light, shards, seed)
    return placed.select("doc.doc_id", "doc.size", "doc.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
