"""Running sums and ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.session import written


def running_sum(df: DataFrame, group: str, order: list[str], size: Column, name: str) -> DataFrame:
    """df with the sum of `size` over the rows of its group up to and with each row, in the given order.

    Rows are range-partitioned by group and order, so a hot group lies in many partitions; sums
    run inside a partition, and one sum a partition and group is summed up across partitions.
    """
    ranged = df.withColumn("_size", size).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    r = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "running").withColumn("_part", F.shiftright("_at", 33))
    sums = r.groupBy("_part", group).agg(F.sum("_size").alias("_s"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = r.withColumn("_in", F.sum("_size").over(inside)).join(before, (F.col("_part") == F.col("_p")) & r[group].eqNullSafe(F.col("_g")))
    return j.withColumn(name, F.col("_before") + F.col("_in")).drop("_size", "_at", "_part", "_p", "_g", "_before", "_in")
