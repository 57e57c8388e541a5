"""Report jobs: materiality, cooldown, deduplication and daily caps; form effectivity; budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.running import running_sum
from statuta.session import written

ALWAYS, BYPASS, INTENSITY, COOLDOWN, HORIZON = 5, 3, 60.0, 7, 7


def materiality(level: Column, status_changed: Column, intensity: Column) -> Column:
    """Struct (worth, reason): high level, else a status change, else a high intensity."""
    n = F.coalesce(level, F.lit(99))
    text = F.format_string("%.0f", intensity.cast("double"))
    reason = (
        F.when(n <= ALWAYS, F.concat(F.lit("cap_hieu_luc_"), n.cast("string")))
        .when(status_changed, F.lit("doi_trang_thai_hieu_luc"))
        .when(intensity >= INTENSITY, F.concat(F.lit("cuong_do_"), text))
        .otherwise(F.concat(F.lit("duoi_nguong (cap "), n.cast("string"), F.lit(", cuong do "), text, F.lit(")")))
    )
    return F.struct(((n <= ALWAYS) | status_changed | (intensity >= INTENSITY)).alias("worth"), reason.alias("reason"))


def out_of_cooldown(candidates: DataFrame, jobs: DataFrame, day: Column, days: int = COOLDOWN) -> DataFrame:
    """Candidates (code, level, …) whose industry had no b-report within `days`, or of a very high level."""
    recent = jobs.where((F.col("kind") == "b") & F.col("status").isin("DONE", "RUNNING", "QUEUED") & (F.col("created_at") >= F.date_sub(day, days)))
    busy = recent.select(F.col("code").alias("_busy")).distinct()
    j = candidates.join(busy, candidates["code"] == busy["_busy"], "left")
    return j.where(F.col("_busy").isNull() | (F.col("level") <= BYPASS)).drop("_busy")


def schedule(new: DataFrame, booked: DataFrame, cap: int, horizon: int = HORIZON) -> DataFrame:
    """Give each new job (day, ord, key) the first day with room, at most `horizon` days on; else null.

    booked: (day, n) of jobs that already count. Jobs of one starting day are taken in the order
    of ord, earlier days first. Whole days are filled, so this folds over days, not jobs: jobs of
    a day are ranked, and each day's free places become intervals of ranks.
    """
    ranked = running_sum(new, "day", ["ord", "key"], F.lit(1), "_r")
    sizes = new.groupBy("day").agg(F.count("*").alias("n"))
    per_day = sizes.withColumn("what", F.lit("new")).unionAll(booked.select("day", "n", F.lit("old").alias("what")))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        used = f[f["what"] == "old"].groupby("day")["n"].sum().to_dict()
        rows = []
        for start, n in sorted(f[f["what"] == "new"].groupby("day")["n"].sum().items()):
            at = 1
            for ahead in range(horizon + 1):
                d = start + pd.Timedelta(days=ahead)
                take = min(n - at + 1, max(0, cap - int(used.get(d, 0))))
                if take > 0:
                    rows.append((start, at, at + take - 1, d))
                    used[d] = used.get(d, 0) + take
                    at += take
                if at > n:
                    break
        return pd.DataFrame(rows, columns=["day", "first", "last", "scheduled_for"])

    # One row a calendar day: a few thousand at most, however many jobs there are.
    slots = per_day.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fold, "day date, first long, last long, scheduled_for date")
    s = slots.select(F.col("day").alias("_d"), "first", "last", "scheduled_for")
    j = ranked.join(F.broadcast(s), (ranked["day"] == s["_d"]) & ranked["_r"].between(s["first"], s["last"]), "left")
    return j.drop("_r", "_d", "first", "last")


#: States of a form, worst first.
FORM_STATES = ("het_hieu_luc", "co_ban_thay_the", "can_kiem_tra", "khong_ro", "con_hieu_luc")


def reference_state(state: Column, enders: Column, amenders: Column) -> Column:
    """State of a form by one reference: its document's state and who ends or amends it."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return (
        F.when(state == "het_toan_bo", FORM_STATES[0]).when(has(enders), FORM_STATES[1])
        .when(state.isin("het_mot_phan", "chua_hieu_luc") | has(amenders), FORM_STATES[2])
        .when(state == "con_hieu_luc", FORM_STATES[4]).otherwise(FORM_STATES[3])
    )


def worst_wins(refs: DataFrame, form: str, state: str, ord_: str, replaced: str | None = None) -> DataFrame:
    """(form, state, reasons, replaced_by): the worst state, the first of equals; replacements in order, distinct."""
    rank = F.array_position(F.array(*[F.lit(s) for s in FORM_STATES]), F.col(state))
    out = [F.min_by(state, F.struct(rank, F.col(ord_))).alias("state"), F.count("*").alias("n_refs")]
    if replaced:
        lists = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(replaced).alias("r")))), lambda s: F.coalesce(s["r"], F.array().cast("array<string>")))
        out.append(F.array_distinct(F.flatten(lists)).alias("replaced_by"))
    return refs.groupBy(form).agg(*out)


def packed_by_budget(sizes: Column, budget: int) -> Column:
    """Batch number of each item of an ordered array, greedily filled to a budget; an oversize item is alone."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        fresh = (acc["batch"] < 0) | (acc["used"] + size > budget)
        batch = F.when(fresh, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.when(fresh, size.cast("long")).otherwise(acc["used"] + size).cast("long").alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def budget_batches(rows: DataFrame, group: str, order: list[str], size: str, budget: int, name: str = "batch") -> DataFrame:
    """rows with the number of their batch (from 0): a group's rows in order (unique in a group), greedily filled to a
    budget; an oversize row is alone. A null size is 0.

    A group may be of any size. Running sums tell for every row where a batch that began there would end; the batches that
    really begin are those reachable from the first row, found by doubling the steps: as many rounds as the logarithm of the
    number of batches, each a join.
    """
    r = running_sum(rows.withColumn("_len", F.coalesce(F.col(size), F.lit(0)).cast("long")).withColumn("_w", F.col("_len")), group, order, F.col("_w"), "_upto")
    r = written(running_sum(r, group, order, F.lit(1), "_place").withColumn("_key", F.struct(group)), "budget-rows")
    # How many rows of the group end at or before the place where a batch from here is full.
    ends = r.select("_key", F.col("_upto").alias("_v"), F.lit(0).alias("_kind"), "_place", F.lit(1).alias("_one"))
    full = r.select("_key", (F.col("_upto") - F.col("_w") + budget).alias("_v"), F.lit(1).alias("_kind"), "_place", F.lit(0).alias("_one"))
    met = running_sum(ends.unionByName(full), "_key", ["_v", "_kind", "_place"], F.col("_one"), "_many").where("_kind = 1")
    jump = written(met.select("_key", "_place", (F.greatest("_many", "_place") + 1).alias("_to")), "budget-steps")
    last = r.groupBy("_key").agg(F.max("_place").alias("_last"))
    jump = written(jump.join(last, "_key").where("_to <= _last").drop("_last"), "budget-steps")
    starts = written(last.select("_key", F.lit(1).cast("long").alias("_place")), "budget-starts")
    while not jump.isEmpty():
        more = starts.join(jump, ["_key", "_place"]).select("_key", F.col("_to").alias("_place"))
        if more.isEmpty():
            break
        starts = written(starts.unionByName(more).distinct(), "budget-starts")
        then = jump.select("_key", F.col("_place").alias("_to"), F.col("_to").alias("_then"))
        jump = written(jump.join(then, ["_key", "_to"]).select("_key", "_place", F.col("_then").alias("_to")), "budget-steps")
    flagged = r.join(starts.withColumn("_first", F.lit(1)), ["_key", "_place"], "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    out = running_sum(flagged, "_key", ["_place"], F.col("_first"), "_batch")
    return out.withColumn(name, (F.col("_batch") - 1).cast("int")).select(*[c for c in rows.columns if c != name], name)
