"""Regulatory impact per industry: two layers of relevance, fused; raw impact; two percentages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from statuta.functions.facts import level_weight
from statuta.operators.running import running_sum

LEXICON, EMBEDDING, BEST = 0.45, 0.55, 5


def centroids(vectors: DataFrame, group: str, v: str, digits: int | None = None) -> DataFrame:
    """(group, at, value): the mean vector of each group, a row a component.

    Every Arrow batch is summed up to one row a group, so what is shuffled follows the groups, not the vectors. Null
    components count for nothing; vectors may be of different lengths.
    """
    kind = vectors.schema[group].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not size.sum():
                continue
            names = b.column(0).dictionary_encode(null_encoding="encode")
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x = lists.flatten()
            there = x.is_valid().to_numpy(zero_copy_only=False)
            width, many = int(size.max()), len(names.dictionary)
            cell = names.indices.to_numpy(zero_copy_only=False)[row] * width + at
            values = pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            total = np.bincount(cell, weights=values, minlength=many * width).reshape(many, width)
            n = np.bincount(cell, weights=there, minlength=many * width).reshape(many, width).astype(np.int64)
            had = np.bincount(cell, minlength=many * width).reshape(many, width)
            lists = [pa.array(x.tolist(), pa.list_(t)) for x, t in ((total, pa.float64()), (n, pa.int64()), (had, pa.int64()))]
            yield pa.RecordBatch.from_arrays([names.dictionary, *lists], ["g", "total", "n", "had"])

    parts = vectors.select(group, v).mapInArrow(sums, StructType([StructField("g", kind), *StructType.fromDDL("total array<double>, n array<long>, had array<long>").fields]))
    e = parts.select("g", F.posexplode(F.arrays_zip("total", "n", "had")).alias("at", "x")).where("x.had > 0")
    mean = F.sum("x.total") / F.nullif(F.sum("x.n"), F.lit(0))
    return e.groupBy(F.col("g").alias(group), "at").agg((F.round(mean, digits) if digits is not None else mean).alias("value"))


def as_vectors(components: DataFrame, group: str) -> DataFrame:
    """(group, centroid) from component rows."""
    return components.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("centroid"))


def shares(scores: DataFrame, unit: str, score: str, name: str) -> DataFrame:
    """Scores normalised to a sum of 1 per unit; units of sum 0 go."""
    total = F.sum(score).over(Window.partitionBy(unit))
    return scores.withColumn("_t", total).where("_t > 0").withColumn(name, F.col(score) / F.col("_t")).drop("_t")


def softmax(x: str, unit: str) -> Column:
    w = Window.partitionBy(unit)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return e / F.sum(e).over(w)


def best_mean(z: DataFrame, keys: list[str], value: str, order: list[str], k: int = BEST, name: str = "score") -> DataFrame:
    """Mean of the k largest values per key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), *order))
    return z.withColumn("_r", r).where(F.col("_r") <= k).groupBy(*keys).agg(F.avg(value).alias(name))


def fused(lexicon: DataFrame, embedding: DataFrame, doc: str, code: str) -> DataFrame:
    """(doc, code, rel_lexicon, rel_embedding, relevance).

    A document that one layer does not know at all has the other layer's relevance in full; a
    present zero counts as zero.
    """
    j = lexicon.select(doc, code, F.col("rel").alias("rel_lexicon")).join(embedding.select(doc, code, F.col("rel").alias("rel_embedding")), [doc, code], "full")
    w = Window.partitionBy(doc)
    has_l, has_e = (F.max(F.col(c).isNotNull()).over(w) for c in ("rel_lexicon", "rel_embedding"))
    l, e = F.coalesce("rel_lexicon", F.lit(0.0)), F.coalesce("rel_embedding", F.lit(0.0))
    rel = F.when(has_l & has_e, LEXICON * l + EMBEDDING * e).when(has_l, l).otherwise(e)
    return j.select(doc, code, l.alias("rel_lexicon"), e.alias("rel_embedding"), rel.alias("relevance"))


def impact(rows: DataFrame, doc: str) -> DataFrame:
    """Add impact_raw = restrictions * relevance * level weight and impact_pct_doc (100 per document)."""
    raw = F.col("restrictions") * F.col("relevance") * level_weight(F.col("level"))
    out = rows.withColumn("impact_raw", raw)
    total = F.sum("impact_raw").over(Window.partitionBy(doc))
    return out.withColumn("_t", total).withColumn("impact_pct_doc", F.when(F.col("_t") > 0, 100 * F.col("impact_raw") / F.col("_t")).otherwise(0.0)).drop("_t")


def percentile_vs_reference(rows: DataFrame, group: str, value: str, is_reference: Column, name: str) -> DataFrame:
    """100 * (reference rows of the group at or below the value) / (reference rows of the group); 0 without any.

    Ties are counted once a value: counts per distinct value are summed, partition by partition, so
    neither the rows of a value nor those of a group need to meet in one task.
    """
    flagged = rows.withColumn("_ref", is_reference.cast("int"))
    counts = flagged.groupBy(group, value).agg(F.sum("_ref").alias("_n"))
    upto = running_sum(counts, group, [value], F.col("_n"), "_upto").select(F.col(group).alias("_g"), F.col(value).alias("_v"), "_upto")
    whole = flagged.groupBy(F.col(group).alias("_h")).agg(F.sum("_ref").alias("_all"))
    share = upto.join(whole, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", F.when(F.col("_all") > 0, 100.0 * F.col("_upto") / F.col("_all")).otherwise(0.0).alias(name))
    j = flagged.join(share, flagged[group].eqNullSafe(F.col("_g")) & flagged[value].eqNullSafe(F.col("_v")))
    return j.drop("_ref", "_g", "_v")
