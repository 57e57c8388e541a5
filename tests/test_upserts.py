"""A table of merged batches against the same merges in a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import kept
from statuta.sources import upserts

ROW = "a string, b int, name string, status string, flag boolean, at long, gone boolean"


def batches(seed, n=5):
    rng = random.Random(seed)
    return [[(rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None]), rng.choice(["p", "", None, "q"]), rng.choice(["s", "t", None]), rng.choice([True, False, None]), at, rng.random() < 0.1)
             for at in range(rng.randrange(1, 25))] for _ in range(n)]


def slow(some, rule):
    table = {}
    for rows in some:
        last = {}
        for r in rows:
            last[r[:2]] = r
        for k, r in last.items():
            old = table.get(k)
            if r[6]:
                table.pop(k, None)
            elif old is None or rule == "replace":
                table[k] = (r[2], r[3], bool(r[4]) if rule == "merge" else r[4])
            elif rule == "merge":
                name = r[2] if old[0] in (None, "") and r[2] is not None else old[0]
                table[k] = (name, r[3] if r[3] is not None else old[1], bool(old[2]) or bool(r[4]))
    return table


def table(tmp_path, rule):
    return upserts.Table(str(tmp_path / rule), ["a", "b"], rule, refresh=("status",), sticky=("flag",), order="at", deleted="gone", buckets=4)


@pytest.mark.parametrize("rule", upserts.RULES)
def test_batches_equal_merges_one_by_one(spark, tmp_path, rule):
    t, some = table(tmp_path, rule), batches(3)
    for i, rows in enumerate(some):
        df = spark.createDataFrame(rows, ROW)
        assert t.apply(df, i)
        assert not t.apply(df, i)  # the batch comes again
    want = slow(some, rule)
    got = {(r["a"], r["b"]): (r["name"], r["status"], r["flag"]) for r in t.read(spark).collect()}
    assert got == want and t.read(spark).count() == len(want) and "gone" not in t.read(spark).columns


def test_untouched_buckets_stay_and_half_written_ones_are_not_read(spark, tmp_path):
    t = upserts.Table(str(tmp_path / "t"), ["k"], buckets=16)
    t.apply(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), 0)
    t.apply(spark.createDataFrame([(7, "new")], "k long, v string"), 1)
    _, places, ledger = t._state(spark)
    assert sorted(places.values()) == [0] * 15 + [1] and ledger == {"batch": 1}
    # A driver that was lost before the list of buckets was written.
    kept.save(spark.createDataFrame([(7, "lost")], "k long, v string"), t.path, 2, "rows")
    assert {r["v"] for r in t.read(spark).where("k = 7").collect()} == {"new"} and t.read(spark).count() == 200
    t.apply(spark.createDataFrame([(7, "again", 1)], "k long, v string, more int"), 2)
    assert [tuple(r) for r in t.read(spark).where("k = 7").select("v", "more").collect()] == [("again", 1)] and t.read(spark).where("more IS NULL").count() == 199


def test_a_stream_that_starts_over_changes_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.range(i * 10, i * 10 + 15).select((F.col("id") % 20).alias("k"), "id").coalesce(1).write.mode("append").parquet(src)
    t = upserts.Table(str(tmp_path / "t"), ["k"], order="id", buckets=4)
    counts = []
    for checkpoint in ("c1", "c1", "c2"):  # goes on; starts over with the same stream name
        stream = spark.readStream.schema("k long, id long").option("maxFilesPerTrigger", 1).parquet(src)
        stream.writeStream.foreachBatch(t.batch("ids")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        counts.append((kept.generations(spark, t.path), sorted(map(tuple, t.read(spark).select("k", "id").collect()))))
    assert counts[0] == counts[1] == counts[2] and len(counts[0][0]) == 3 and [k for k, _ in counts[0][1]] == list(range(20))


def test_rules_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        upserts.Table("x", ["k"], "overwrite")
    with pytest.raises(ValueError):
        upserts.Table(str(tmp_path / "none"), ["k"]).read(spark)
