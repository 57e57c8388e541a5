"""A table that batches are merged into: for batch jobs, and for a stream's foreachBatch.

    sink = upserts.Table(path, ["doc_key", "chunk_index"], rule="replace")
    stream.writeStream.foreachBatch(sink.batch("chunks")).option("checkpointLocation", ...).start()

Rows lie in buckets of their key's hash; a batch rewrites the buckets that it touches, the others stay where they are. What has
been applied is a ledger beside the list of buckets, and both are one small table that is written last: a batch that comes again
(after a lost driver) changes nothing, and a reader sees a batch wholly or not at all. One writer at a time.

Rules for a key that is there already: `replace` takes the new row; `keep` leaves the old one; `merge` fills what is null, empty or
false, `refresh` columns take a new value that isn't null, `sticky` flags stay true. A row with `deleted` set (a column that isn't
kept) takes its key away. Of rows of one key in a batch the last by `order` counts, then the one of the smallest hash. Nulls in a key are
a value like any other. A column that the table lacks is added, one that a batch lacks is null there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.kept import generations, load, place, save
from statuta.session import written
from statuta.streaming.scans import whole_row

RULES = ("replace", "keep", "merge")


class Table:
    """A keyed table under a path."""

    def __init__(
        self, path: str, key: list[str], rule: str = "replace", refresh: tuple[str, ...] = (), sticky: tuple[str, ...] = (), order: str | None = None, deleted: str | None = None, buckets: int = 64
    ) -> None:
        if rule not in RULES:
            raise ValueError(f"a rule is one of {', '.join(RULES)}")
        self.path, self.key, self.rule, self.refresh, self.sticky = path, key, rule, refresh, sticky
        self.order, self.deleted, self.buckets = order, deleted, buckets

    def _state(self, spark: SparkSession) -> tuple[int, dict[int, int], dict[str, int]]:
        """(last generation, the generation that holds each bucket, the last batch of each stream)."""
        found = generations(spark, self.path)
        if not found:
            return -1, {}, {}
        whole = load(spark, self.path, found[-1:], "whole").first()
        if whole["buckets"] != self.buckets:
            raise ValueError(f"the table has {whole['buckets']} buckets")
        return found[-1], dict(whole["places"]), dict(whole["ledger"])

    def _bucket(self, name: str = "_k") -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """rows with their key as one text."""
        return rows.withColumn("_k", F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(self.key)]), {"ignoreNullFields": "false"}))

    def _rows(self, spark: SparkSession, places: dict[int, int], some: set[int] | None = None) -> DataFrame | None:
        at = [f"{place(self.path, g, 'rows')}/_bucket={b}" for b, g in sorted(places.items()) if some is None or b in some]
        return spark.read.option("mergeSchema", "true").parquet(*at) if at else None

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows as they are."""
        _, places, _ = self._state(spark)
        rows = self._rows(spark, places)
        if rows is None:
            raise ValueError(f"nothing was written yet: {self.path}")
        return rows.drop("_k")

    def _merged(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        gone = new.where(F.coalesce(F.col(self.deleted).cast("boolean"), F.lit(False))).select("_k") if self.deleted else None
        fresh = new if gone is None else new.where(~F.coalesce(F.col(self.deleted).cast("boolean"), F.lit(False))).drop(self.deleted)
        if self.rule == "merge":
            fresh = fresh.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in self.sticky if c in fresh.columns})
        if old is None:
            return fresh
        if gone is not None:
            old = old.join(gone, "_k", "left_anti")
        if self.rule != "merge":
            kept, other = (old.join(fresh.select("_k"), "_k", "left_anti"), fresh) if self.rule == "replace" else (old, fresh.join(old.select("_k"), "_k", "left_anti"))
            return kept.unionByName(other, allowMissingColumns=True)
        there = {c.lower(): c for c in old.columns}
        o, n = old.alias("o"), fresh.alias("n")

        def one(c: str) -> Column:
            before = F.col(f"o.`{there[c.lower()]}`") if c.lower() in there else F.lit(None)
            after = F.col(f"n.`{c}`") if c in fresh.columns else F.lit(None)
            if c in self.sticky:
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
            if c in self.refresh or c == "_k" or c in self.key:
                return F.coalesce(after, before)
            empty = before.isNull() | before.cast("string").isin("", "false")
            return F.when(empty & after.isNotNull(), after).otherwise(before)

        columns = list(dict.fromkeys([*old.columns, *fresh.columns]))
        return o.join(n, F.col("o._k") == F.col("n._k"), "full").select(*[one(c).alias(c) for c in columns])

    def apply(self, rows: DataFrame, batch: int, stream: str = "batch") -> bool:
        """Merge a batch in; False if this batch of the stream was applied already."""
        spark = rows.sparkSession
        last, places, ledger = self._state(spark)
        if ledger.get(stream, -1) >= batch:
            return False
        latest = [F.desc(self.order)] if self.order else []
        r = F.row_number().over(Window.partitionBy("_k").orderBy(*latest, *whole_row(rows)))
        new = self._keyed(rows).withColumn("_r", r).where("_r = 1").drop("_r")
        new = written(new.withColumn("_bucket", self._bucket()), "upsert-batch")
        touched = {x["_bucket"] for x in new.select("_bucket").distinct().collect()}  # buckets at most
        old = self._rows(spark, places, touched)
        out = self._merged(old, new.drop("_bucket"))
        out = out.withColumn("_bucket", self._bucket()).repartition(min(self.buckets, max(1, len(touched))), "_bucket")
        where = place(self.path, last + 1, "rows")
        out.write.mode("overwrite").partitionBy("_bucket").parquet(where)
        # A bucket that has lost its last row has no folder.
        left = {x["_bucket"] for x in spark.read.parquet(where).select("_bucket").distinct().collect()} if not out.isEmpty() else set()
        places = {b: g for b, g in places.items() if b not in touched} | dict.fromkeys(left, last + 1)
        ledger[stream] = batch
        save(spark.createDataFrame([(places, ledger, self.buckets)], "places map<int,int>, ledger map<string,bigint>, buckets int"), self.path, last + 1, "whole")
        return True

    def batch(self, stream: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch calls."""
        return lambda rows, number: self.apply(rows, number, stream) and None
