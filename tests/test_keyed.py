"""Keyed state against the same table read at once."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.streaming import keyed, scans

DAY = 86_400


def landed(spark, folder, batches):
    """A file a batch, in the order of their names."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k long, sec long, n long, s string").withColumn("t", F.timestamp_seconds("sec"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema("k long, sec long, n long, s string, t timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def changes(spark, stream, out, **options):
    scans.run_available(keyed.status_changes(stream, "k", "t", "s", tie="n", **options), f"{out}/o", f"{out}/c")
    return sorted((r["k"], str(r["t"]), r["old_status"], r["new_status"]) for r in spark.read.parquet(f"{out}/o").collect())


def at_once(spark, rows):
    df = spark.createDataFrame(rows, "k long, sec long, n string, s string").withColumn("t", F.timestamp_seconds("sec"))
    got = scans.status_changes(df, "k", ["t", "n", "s"], "s").collect()
    return sorted((r["k"], str(r["t"]), r["old_status"], r["new_status"]) for r in got)


END = (-1, 10**9, 0, "end")


def test_a_hot_key_in_any_order_over_three_batches(spark, tmp_path):
    """30,000 rows of one key, shuffled, with one true change; another key changes all the time."""
    rng = random.Random(3)
    rows = [(1, 1000 + i, 0, "A" if i < 20_000 else "B") for i in range(30_000)] + [(2, 1000 + 10 * i, 0, rng.choice(["A", "B", None])) for i in range(500)]
    rng.shuffle(rows)
    cut = [rows[i::3] for i in range(3)]
    stream = landed(spark, str(tmp_path / "in"), [*cut, [END]])
    got = changes(spark, stream, str(tmp_path), lateness="1 day")
    assert got == at_once(spark, [(k, s, str(n), v) for k, s, n, v in rows])
    assert [r[2:] for r in got if r[0] == 1] == [("A", "B")]


@pytest.mark.parametrize("batches", [1, 4])
def test_ties_and_lateness(spark, tmp_path, batches):
    """Rows arrive up to the lateness late; those of one time count in the order of the tie."""
    rng = random.Random(7)
    rows = [(k, 3600 * rng.randrange(1, 200), n, rng.choice("ABC")) for n in range(600) for k in [rng.randrange(5)]]
    rows = [(k, t, 1000 + n, s) for k, t, n, s in rows]  # ties as text are in the order of the numbers
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(3 * 3600))
    step = -(-len(order) // batches)
    stream = landed(spark, str(tmp_path / "in"), [*(order[i : i + step] for i in range(0, len(order), step)), [END]])
    assert changes(spark, stream, str(tmp_path), lateness="3 hours") == at_once(spark, [(k, t, str(n), s) for k, t, n, s in rows])


def test_state_outlives_a_run_and_is_forgotten_in_time(spark, tmp_path):
    first = [(1, 10 * DAY, 1, "A"), (2, 10 * DAY, 1, "A"), (1, 11 * DAY, 1, "B")]
    stream = lambda: landed(spark, str(tmp_path / "in"), [])
    landed(spark, str(tmp_path / "in"), [first])
    for _ in range(2):  # nothing is final yet, then nothing is new
        assert changes(spark, stream(), str(tmp_path), lateness="1 day", forget="30 days") == []
    spark.createDataFrame([(3, 20 * DAY, 1, "x"), (2, 20 * DAY, 1, "C")], "k long, sec long, n long, s string").withColumn("t", F.timestamp_seconds("sec")).coalesce(1).write.parquet(str(tmp_path / "in/001"))
    got = changes(spark, stream(), str(tmp_path), lateness="1 day", forget="30 days")
    assert [r[0] for r in got] == [1] and got[0][2:] == ("A", "B")
    spark.createDataFrame([(1, 90 * DAY, 1, "Z"), (2, 40 * DAY, 1, "A"), (-1, 200 * DAY, 1, "end")], "k long, sec long, n long, s string").withColumn("t", F.timestamp_seconds("sec")).coalesce(1).write.parquet(str(tmp_path / "in/002"))
    got = changes(spark, stream(), str(tmp_path), lateness="1 day", forget="30 days")
    # Key 2 went from A to C and back within 30 days; key 1 had been silent for longer before Z.
    assert [(r[0], r[2], r[3]) for r in got] == [(1, "A", "B"), (2, "A", "C"), (2, "C", "A")]


def test_arrivals_are_new_or_changed(spark, tmp_path):
    rows = [(1, 10, 0, "x"), (1, 20, 0, "x"), (1, 30, 0, "y"), (2, 5, 0, None), (2, 6, 0, None), (2, 7, 0, "z")]
    stream = landed(spark, str(tmp_path / "in"), [rows[3:], rows[:3], [END]])
    scans.run_available(keyed.arrivals(stream, "k", "t", "s", lateness="1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = sorted((r["k"], r["kind"], r["s"] or "") for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == [(1, "changed", "y"), (1, "new", "x"), (2, "changed", "z"), (2, "new", "")]


def test_high_water_never_moves_back(spark, tmp_path):
    stream = landed(spark, str(tmp_path / "in"), [[(1, 50, 0, "a")], [(1, 20, 0, "a"), (2, 5, 0, "a")]])
    marks = []
    q = keyed.high_water(stream, "k", "sec").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    q.foreachBatch(lambda df, i: marks.extend((i, r["k"], r["high_water"]) for r in df.collect())).start().awaitTermination()
    assert {k: max(h for _, j, h in marks if j == k) for _, k, _ in marks} == {1: 50, 2: 5} and [h for _, k, h in sorted(marks) if k == 1] in ([50], [50, 50])


def test_latest_row_of_a_key_is_no_chance(spark):
    rows = [(1, 5, i, "s") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, at long, n long, s string")
    got = {scans.new_rows(df.repartition(n), "k", "at", F.lit(0)).first()["n"] for n in (1, 2, 5, 9)}
    assert len(got) == 1


class Listed:
    """A list state that tells how many entries it holds."""

    def __init__(self):
        self.entries = []

    def appendValue(self, entry):
        self.entries.append(entry)

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return None

    def registerTimer(self, at):
        self.timer = at


def test_rows_of_a_key_are_few_entries_of_its_state():
    rows = [(1, None, f'["{10**6 + i * 1000}","","A"]') for i in range(2 * keyed.HELD + 1)]
    state, processor = Listed(), keyed._Changes(None)
    processor.init(state)
    assert list(processor.handleInputRows((1,), iter(rows[::-1]), None)) == []
    assert len(state.entries) == 3 and state.timer == 1001


def test_any_text_is_a_status(spark, tmp_path):
    texts = ['a"b', "a,b]", "\\", "đã hết\n", None, "", "😀"]
    rows = [(1, 100 + i, i, s) for i, s in enumerate(texts * 2)]
    stream = landed(spark, str(tmp_path / "in"), [rows, [END]])
    assert changes(spark, stream, str(tmp_path), lateness="1 hour") == at_once(spark, [(k, t, str(n), s) for k, t, n, s in rows])
