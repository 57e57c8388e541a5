"""Incremental scans: high-water marks, deduplication, status changes; batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from statuta.streaming.keyed import PROVIDER, ROCKS


def whole_row(rows: DataFrame) -> list[Column]:
    """An order of rows that leaves nothing to chance: a hash of all columns, then those that have an order."""
    known = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return [F.xxhash64(*known), *known]


def new_rows(rows: DataFrame, key: str, at: str, cutoff: Column) -> DataFrame:
    """One row a key (the latest) not older than the cutoff; of several the one of the smallest hash of all columns."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *whole_row(rows)))
    return rows.where(F.col(at) >= cutoff).withColumn("_r", r).where("_r = 1").drop("_r")


def advanced(marks: DataFrame, scanned: DataFrame, source: str, at: str) -> DataFrame:
    """High-water marks that never move back; sources not scanned keep theirs."""
    s = scanned.groupBy(source).agg(F.max(at).alias("_new"))
    j = marks.join(s, source, "full")
    return j.select(source, F.greatest("high_water", "_new").alias("high_water"))


def status_changes(events: DataFrame, key: str, at: list[str], status: str) -> DataFrame:
    """Rows whose status differs from that of the key's row before, with both."""
    w = Window.partitionBy(key).orderBy(*at)
    e = events.withColumn("old_status", F.lag(status).over(w))
    return e.where(F.col("old_status").isNotNull() & (F.col("old_status") != F.col(status))).withColumnRenamed(status, "new_status")


def stream_latest(stream: DataFrame, key: list[str], at: str, lateness: str = "45 days") -> DataFrame:
    """A stream without repeated keys within the lateness."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def monthly_counts(stream: DataFrame, at: str, lateness: str = "45 days") -> DataFrame:
    """Counts by 30-day windows of a stream."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, "30 days")).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over all landed files once; the checkpoint advances only after the sink has the rows. The state
    store is RocksDB; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
    query.awaitTermination()


def land_snapshot(df: DataFrame, path: str, source: str, day: str) -> None:
    """Append a daily snapshot, partitioned by source and day."""
    df.withColumn("source", F.lit(source)).withColumn("day", F.lit(day)).write.mode("append").partitionBy("source", "day").parquet(path)
