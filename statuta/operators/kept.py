"""Kept tables in generations: folders `gen=N` under a path, each with named Parquet tables.

A generation counts once its table `whole` is there, which is written last: what a lost driver leaves half written is
overwritten by the next attempt and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each up to which a table is sent to every task instead of shuffling what it meets.
FEW = 1 << 20


def place(path: str, generation: int, name: str) -> str:
    return f"{path.rstrip('/')}/gen={generation}/{name}"


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished generations, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    found = sorted(int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit())
    return [g for g in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(place(path, g, "whole") + "/_SUCCESS"))]


def save(df: DataFrame, path: str, generation: int, name: str) -> DataFrame:
    """The table as it was written."""
    where = place(path, generation, name)
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def load(spark: SparkSession, path: str, found: list[int], name: str) -> DataFrame:
    """The table of all these generations together."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*[place(path, g, name) for g in found])


def light(df: DataFrame, most: int = FEW) -> DataFrame:
    """df to be broadcast if it has at most `most` rows; else what it meets is shuffled."""
    return F.broadcast(df) if df.count() <= most else df
