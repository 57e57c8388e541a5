"""Job outcomes: the citation gate in all its ways, and how rows are dealt."""

import pytest
from pyspark.sql import functions as F

from statuta.operators import kept, records


def tables(spark, n):
    """Jobs in threes (a, b, c), most of them without a parent; every output cites the same four numbers and one of its own."""
    k = F.col("id")
    jobs = spark.range(n).select(k.alias("job"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 6 == 2, k - 1).alias("parent"))
    own = F.concat(F.lit("x"), (k % 50).cast("string"))
    cited = F.array(F.lit("1"), F.lit("2"), F.when(k % 5 == 0, "9").otherwise("3"), F.lit("1"), own)
    out = spark.range(n).where("id % 11 <> 0").select(k.alias("job"), F.when(k % 13 == 0, "boom").alias("error"), cited.alias("cited"), F.when(k % 10 == 0, F.array(F.lit("9"))).alias("allowed"))
    known = spark.createDataFrame([("1",), ("2",), ("3",), *((f"x{i}",) for i in range(49))], "number string")
    return jobs, out, known


def slow(n):
    ran = {k: k % 13 == 0 for k in range(n) if k % 11}
    for k in range(n):
        fed = k % 6 == 2 and ran.get(k - 1) is False
        error = "parent has no output" if k % 3 == 2 and not fed else "no output" if k not in ran else "boom" if ran[k] else None
        missing = (k % 5 == 0 and k % 10 != 0) + (k % 50 == 49)
        yield (k, "abc"[k % 3], *((records.FAILED, None, None) if error else (records.BLOCKED if missing else records.DONE, 4, missing)), error)


@pytest.mark.parametrize("few", [kept.FEW, 20])
def test_outcomes_equal_one_job_at_a_time(spark, monkeypatch, few):
    monkeypatch.setattr(kept, "FEW", few)
    assert sorted(map(tuple, records.outcomes(*tables(spark, 600)).collect()), key=lambda r: r[0]) == list(slow(600))


def test_no_task_gets_the_jobs_of_one_number_or_of_no_parent(spark, tmp_path):
    for name, t in zip(("jobs", "out", "known"), tables(spark, 24_000)):
        t.write.parquet(str(tmp_path / name))
    store, jvm, gateway = spark._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()

    def stages():
        found = store.stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        records.outcomes(*(spark.read.parquet(str(tmp_path / x)) for x in ("jobs", "out", "known"))).write.format("noop").mode("overwrite").save()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    most = 0
    for s in stages():
        if s.stageId() not in before and s.shuffleReadRecords():
            tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
            most = max(most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())))
    assert 0 < most <= 24_000 // 2  # a stage reads up to five shuffles; a sixteenth of each
