"""Counts, shares and rates of any table: columns are named by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, n): what is cited and not known, with how often."""
    return cited.join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows are more than one a key; null if none is."""
    return repeated(df, keys).agg(F.sum(F.col("n") - 1).alias("extra"))


def maximum_or_one(x: Column) -> Column:
    """The largest value; 1 where it is null or 0, so that it can divide."""
    return F.when(F.coalesce(F.max(x), F.lit(0)) == 0, F.lit(1)).otherwise(F.max(x))


def pivoted(df: DataFrame, group: str, state: str, states: list[str]) -> DataFrame:
    """(group, a count for each state): 0 where there is none."""
    return df.groupBy(group).pivot(state, states).count().fillna(0, states)


def counted_in_each(df: DataFrame, tags: Column, name: str = "tag") -> DataFrame:
    """(tag, n): rows counted once in each of their groups."""
    return df.select(F.explode(F.array_distinct(tags)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def largest_groups(df: DataFrame, group: str, n: int, least: int) -> DataFrame:
    """(group, n) of the n largest groups, ties by name; none if there are fewer than `least` groups."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    enough = g.agg((F.count("*") >= least).alias("_ok"))  # one row
    return g.join(F.broadcast(enough)).where("_ok").drop("_ok").orderBy(F.desc("n"), group).limit(n)


def months(df: DataFrame, day: str, since: Column, least: int, n: int) -> DataFrame:
    """(month as MM/yy, n): the first n months since a day that have at least `least` rows, in the calendar's order."""
    month = F.date_trunc("month", F.col(day))
    g = df.where(F.col(day) >= since).groupBy(month.alias("_m")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.orderBy("_m").limit(n).select(F.date_format("_m", "MM/yy").alias("month"), "n")


def largest_shares(df: DataFrame, group: str, value: str, n: int, digits: int) -> DataFrame:
    """(group, share): the n groups of the largest part of the whole, in per cent."""
    g = df.groupBy(group).agg(F.sum(value).alias("_s"))
    share = F.round(100 * F.col("_s") / F.sum("_s").over(Window.partitionBy()), digits)  # a row a group
    return g.withColumn("share", share).orderBy(F.desc("_s"), group).limit(n).select(group, "share")


def rollup(df: DataFrame, group: str, keys: str, lowest: str, highest: str, reason: str, order: list[str]) -> DataFrame:
    """(group, keys, lowest, highest, first_reason): sorted distinct keys, extremes, and the reason of the first row."""
    return df.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set(keys)), ",").alias("keys"), F.min(lowest).alias("lowest"), F.max(highest).alias("highest"),
        F.min_by(reason, F.struct(*order)).alias("first_reason"),
    )


def best_rows(df: DataFrame, group: str, value: str, pick: str, digits: int, least: float) -> DataFrame:
    """(group, pick, top): the row of the largest rounded value, the smaller pick of equals, of groups that reach `least`."""
    v = F.round(value, digits)
    return df.groupBy(group).agg(F.max_by(pick, F.struct(v, -F.col(pick))).alias(pick), F.max(v).alias("top")).where(F.col("top") >= least)


def quality_rates(scores: DataFrame, unit: str, code: str, score: str, n: int, expected: str, allowed: list[str], digits: int) -> DataFrame:
    """(n, hit_rate, violation_rate): how many units have the expected code among their n best, how many none of the allowed."""
    r = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(score), code))
    top = scores.withColumn("_r", r).where(F.col("_r") <= n).groupBy(unit).agg(F.collect_set(code).alias("_top"))
    hit, none = F.array_contains("_top", expected), ~F.arrays_overlap("_top", F.array(*[F.lit(a) for a in allowed]))
    return top.agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), digits).alias("hit_rate"), F.round(F.avg(none.cast("int")), digits).alias("violation_rate"))


def dominant(df: DataFrame, group: str, value: str, digits: int) -> DataFrame:
    """(group, dominant, share): the most frequent value (the larger of equals) and its part."""
    c = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    return c.groupBy(group).agg(F.max_by(value, F.struct("_n", value)).alias("dominant"), F.round(F.max("_n") / F.sum("_n"), digits).alias("share"))


def precision_recall(df: DataFrame, predicted: Column, actual: Column, digits: int) -> DataFrame:
    """One row (prec, rec, f1) of a predicate against what holds; null where nothing was predicted or nothing holds."""
    c = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rate = lambda a, b, name: F.round(a / F.nullif(b, F.lit(0)), digits).alias(name)
    return c.select(rate(tp, tp + fp, "prec"), rate(tp, tp + fn, "rec"), rate(2 * tp, 2 * tp + fp + fn, "f1"))


def root_quotas(df: DataFrame, group: str, total: int, least: int) -> DataFrame:
    """(group, n, quota): parts of a total by the root of the group's size, `least` at least, the size at most."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    share = F.floor(total * F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy()))  # a row a group
    return g.withColumn("quota", F.least(F.col("n"), F.greatest(F.lit(least), share)).cast("long"))


def distribution(df: DataFrame, group: str, digits: int) -> DataFrame:
    """(group, n, pct): counts with their part of the whole."""
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits))  # a row a group


def work_to_redo(rows: DataFrame, ledger: DataFrame, key: str, digest: str, ok: str) -> DataFrame:
    """rows with redo: absent from the ledger (key, digest, ok), changed since, or failed before."""
    known = ledger.select(F.col(key).alias("_k"), F.col(digest).alias("_h"), F.col(ok).alias("_ok"))
    j = rows.join(known, F.col(key) == F.col("_k"), "left")
    return j.withColumn("redo", F.col("_k").isNull() | ~F.col(digest).eqNullSafe(F.col("_h")) | ~F.coalesce("_ok", F.lit(False))).drop("_k", "_h", "_ok")


def smallest_common(df: DataFrame, group: str, code: Column, allowed: list[int]) -> DataFrame:
    """(group, code): the smallest of a group's codes that is allowed; null without one."""
    return df.groupBy(group).agg(F.min(F.when(code.isin(*allowed), code)).alias("code"))


def live_parts(parts: DataFrame, lengths: DataFrame, key: str, number: str, length: str) -> DataFrame:
    """Parts of a document below its new length; those of documents of unknown length stay."""
    n = lengths.select(F.col(key).alias("_k"), F.col(length).alias("_n"))
    return parts.join(n, F.col(key) == F.col("_k"), "left").where(F.col("_n").isNull() | (F.col(number) < F.col("_n"))).drop("_k", "_n")


def sorted_union(df: DataFrame, group: str, *values: Column, name: str = "allowed") -> DataFrame:
    """(group, name): the distinct values of several columns, sorted; nulls are none."""
    lists = [F.collect_set(v) for v in values]
    return df.groupBy(group).agg(F.array_sort(F.array_distinct(F.concat(*lists))).alias(name))


def scoped_counts(codes: DataFrame, documents: DataFrame, code: str, cited: Column) -> DataFrame:
    """(code, n_documents, n_cited, scope): counts over a code's documents; over the whole store where it has none."""
    c = documents.groupBy(F.col(code).alias("_c")).agg(F.count("*").alias("_n"), F.count_if(cited).alias("_cited"))
    whole = documents.agg(F.count("*").alias("_all"))  # one row
    j = codes.select(code).join(c, F.col(code) == F.col("_c"), "left").join(F.broadcast(whole))
    some = F.coalesce("_n", F.lit(0)) > 0
    return j.select(code, F.when(some, F.col("_n")).otherwise(F.col("_all")).alias("n_documents"), F.coalesce("_cited", F.lit(0)).alias("n_cited"), F.when(some, "industry").otherwise("whole store").alias("scope"))
