"""Identity: unique lookups, entity resolution in ranked steps, merging of two sources, merge with history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_lookup(df: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """(key, value) for keys with exactly one row; an ambiguous key has no answer."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.max(value).alias(name or value))
    return g.where("_n = 1").drop("_n")


def resolve(rows: DataFrame, known: DataFrame, row_id: str, steps: list[tuple[str, Column, Column]], target: str) -> DataFrame:
    """Match rows to known ones by the first step that has a match.

    steps: (name, key expression over rows, key expression over known); within a step the smallest
    target wins. Returns (row_id, target, step); rows that match nowhere are absent.
    """
    found = None
    for rank, (name, left, right) in enumerate(steps):
        a = rows.select(row_id, left.alias("_k")).where("_k IS NOT NULL")
        b = known.select(right.alias("_k"), target).where("_k IS NOT NULL").groupBy("_k").agg(F.min(target).alias(target))
        hit = a.join(b, "_k").select(row_id, target, F.lit(rank).alias("_rank"), F.lit(name).alias("step"))
        found = hit if found is None else found.unionAll(hit)
    best = F.min_by(F.struct(target, "step"), F.col("_rank"))
    return found.groupBy(row_id).agg(best.alias("_b")).select(row_id, f"_b.{target}", "_b.step")


def merge_sources(strong: DataFrame, weak: DataFrame, key: str, fields: list[str], keep: Column | None = None) -> DataFrame:
    """Rows of `strong`, filled from the one `weak` row of their key, plus unmatched weak rows that `keep` admits.

    A key with several weak rows matches none. Adds `origin` (both, strong, weak).
    """
    counted = weak.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    single = counted.where("_n = 1").drop("_n")
    w = single.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_w_{f}") for f in fields])
    j = strong.join(w, strong[key] == w["_k"], "left")
    both = j.select(key, *[F.coalesce(f, f"_w_{f}").alias(f) for f in fields], F.when(F.col("_k").isNull(), "strong").otherwise("both").alias("origin"))
    rest = single.join(strong.select(key).distinct(), key, "left_anti")
    if keep is not None:
        rest = rest.where(keep)
    return both.unionByName(rest.select(key, *fields, F.lit("weak").alias("origin")))


def upsert(current: DataFrame, incoming: DataFrame, key: str, refresh: list[str], fill: list[str], sticky: list[str], tracked: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged table, status history) of a keyed upsert.

    Null inputs never overwrite; `fill` columns only fill null, empty or false ones; `refresh`
    columns take the new value; `sticky` flags stay true once true. History has the rows of
    `tracked` whose value changed.
    """
    c, i = current.alias("c"), incoming.alias("i")
    j = c.join(i, F.col(f"c.{key}") == F.col(f"i.{key}"), "full")

    def merged(f: str) -> Column:
        old, new = F.col(f"c.{f}"), F.col(f"i.{f}")
        if f in refresh:
            return F.coalesce(new, old)
        if f in sticky:
            return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
        empty = old.isNull() | (old.cast("string").isin("", "false"))
        return F.when(empty & new.isNotNull(), new).otherwise(old)

    columns = [*fill, *refresh, *sticky]
    out = j.select(F.coalesce(f"c.{key}", f"i.{key}").alias(key), *[merged(f).alias(f) for f in columns], F.col(f"c.{key}").isNull().alias("is_new"))
    if tracked is None:
        return out, out.limit(0)
    changed = F.col(f"c.{key}").isNotNull() & F.col(f"i.{tracked}").isNotNull() & ~F.col(f"c.{tracked}").eqNullSafe(F.col(f"i.{tracked}"))
    history = j.where(changed).select(F.col(f"c.{key}").alias(key), F.col(f"c.{tracked}").alias("old_value"), F.col(f"i.{tracked}").alias("new_value"))
    return out, history


def upsert_coalesced(current: DataFrame, incoming: DataFrame, keys: list[Column], columns: list[str], keep: list[str]) -> DataFrame:
    """Replace rows by a key of expressions (null-safe keys are coalesced by the caller); `keep` columns stay."""
    names = [f"_k{i}" for i in range(len(keys))]
    a = current.select(*[k.alias(n) for k, n in zip(keys, names)], *columns)
    b = incoming.select(*[k.alias(n) for k, n in zip(keys, names)], *columns)
    j = a.alias("a").join(b.alias("b"), names, "full")
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in keep else F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns]
    return j.select(*pick)


def diff(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """keys and `change` (added, removed, changed, same) of two snapshots; null keys are equal."""
    a = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*payload).alias("_o"), F.lit(1).alias("_old"))
    b = new.select(*keys, F.struct(*payload).alias("_p"), F.lit(1).alias("_new"))
    on = [F.col(f"_o_{k}").eqNullSafe(F.col(k)) for k in keys]
    j = a.join(b, on, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_o").eqNullSafe(F.col("_p")), "same").otherwise("changed")
    return j.select(*[F.coalesce(k, f"_o_{k}").alias(k) for k in keys], change.alias("change"))


def delist(known: DataFrame, seen: DataFrame, key: str, day: Column) -> DataFrame:
    """known with delisted_at: null again if listed, the day if newly missing, else as it was."""
    s = seen.select(F.col(key).alias("_s")).distinct()
    j = known.join(s, known[key] == s["_s"], "left")
    return j.withColumn("delisted_at", F.when(F.col("_s").isNotNull(), F.lit(None)).otherwise(F.coalesce("delisted_at", day))).drop("_s")
