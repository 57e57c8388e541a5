"""Ranks, cuts and samples of any table: columns are named by the caller, ties are broken by the order that is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.running import running_sum

Order = list[Column | str]


def _columns(names: list[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def first_of_each(df: DataFrame, group: list[str] | str, order: Order, n: int = 1, name: str = "place") -> DataFrame:
    """The first n rows of each group with their places from 1. Only n rows a group and task are shuffled."""
    r = F.row_number().over(Window.partitionBy(*_columns(group)).orderBy(*order))
    return df.withColumn(name, r).where(F.col(name) <= n)


def margin(df: DataFrame, group: list[str] | str, value: str, order: Order, name: str = "margin") -> DataFrame:
    """The best row of each group with its lead over the runner-up; null without one."""
    top = first_of_each(df, group, [F.desc(value), *order], 2, "_place")
    w = Window.partitionBy(*_columns(group)).orderBy("_place")
    return top.withColumn(name, F.col(value) - F.lead(value).over(w)).where("_place = 1").drop("_place")


def reindexed(df: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """Gapless positions from 0 in each group, of any size."""
    return running_sum(df, group, order, F.lit(1), "_upto").withColumn(name, (F.col("_upto") - 1).cast("long")).drop("_upto")


def systematic_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """Every n-th whole-numbered key, so that about `most` rows come out, and never more."""
    step = max(1, df.count() // most)
    return df.where(F.pmod(key, F.lit(step)) == 0).orderBy(key).limit(most)


def case_rank(x: Column, *first: str) -> Column:
    """0, 1, … for the values that come first, the same larger number for all others."""
    rank = F.lit(len(first))
    for i, v in reversed(list(enumerate(first))):
        rank = F.when(x == v, i).otherwise(rank)
    return rank


def points(*tests: tuple[Column, int]) -> Column:
    """The sum of the weights of the tests that hold; an unknown one doesn't."""
    total = F.lit(0)
    for test, weight in tests:
        total = total + F.when(F.coalesce(test, F.lit(False)), weight).otherwise(0)
    return total


def share_of(value: str, unit: list[str] | str, whole: float = 100.0) -> Column:
    """A row's part of its unit's sum."""
    return whole * F.col(value) / F.sum(value).over(Window.partitionBy(*_columns(unit)))


def joined_in_order(df: DataFrame, group: str, order: list[str], value: str, separator: str, name: str) -> DataFrame:
    """(group, name): the values of each group as one text, in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["_value"].cast("string")), separator).alias(name))
