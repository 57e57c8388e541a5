"""Sinks: incremental publishing by digest, versioned results, JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed_pages(pages: DataFrame, published: DataFrame, key: str, body: str) -> DataFrame:
    """pages with digest and action: new, changed or same, compared with published (key, digest)."""
    p = pages.withColumn("digest", F.sha2(F.col(body), 256))
    old = published.select(F.col(key).alias("_k"), F.col("digest").alias("_d"))
    j = p.join(old, p[key] == old["_k"], "left")
    action = F.when(F.col("_k").isNull(), "new").when(F.col("digest").eqNullSafe(F.col("_d")), "same").otherwise("changed")
    return j.withColumn("action", action).drop("_k", "_d")


def orphans(published: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Published keys that are valid no more; none if there is no valid page at all."""
    some = pages.limit(1).agg((F.count("*") > 0).alias("_some"))
    return published.join(pages.select(key).distinct(), key, "left_anti").join(F.broadcast(some)).where("_some").drop("_some")


def overwrite_version(df: DataFrame, path: str, version: str = "scorer_version") -> None:
    """Replace only the partitions of the versions in df."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def metadata_json(df: DataFrame, internal: tuple[str, ...] = ("id", "created_at", "updated_at")) -> DataFrame:
    """One JSON object a row without internal columns, `_` columns and nulls."""
    kept = [c for c in df.columns if c not in internal and not c.startswith("_")]
    return df.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}).alias("value"))


def positioned(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """0-based positions in an order: counts of range partitions are summed, no task sees all rows."""
    from statuta.session import written

    r = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    r = written(r, "positions")
    part = F.shiftright("_at", 33)
    sizes = r.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_b"))
    j = r.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # one row a range partition
    return j.withColumn(name, (F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at", "_p", "_b")


def queue_upsert(queue: DataFrame, failed: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Retry queue (keys, attempts, last_error): failures come in or count up, successes leave."""
    q = queue.join(done.select(*keys), keys, "left_anti")
    j = q.select(*keys, F.col("attempts").alias("_a"), F.col("last_error").alias("_e")).join(failed.select(*keys, F.col("last_error").alias("_f"), F.lit(1).alias("_new")), keys, "full")
    return j.select(*keys, (F.coalesce("_a", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("attempts"), F.coalesce("_f", "_e").alias("last_error"))
