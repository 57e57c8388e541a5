"""Pages as a data source: where reading stops, what comes twice, and resuming in the middle."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from statuta.sources import paged


def day(n):
    return (datetime.date(2024, 3, 1) - datetime.timedelta(n)).isoformat()


@pytest.fixture
def landed(tmp_path):
    """Ten pages of five items, a day older each page; every page repeats the last item of the one before."""
    for p in range(1, 11):
        items = [{"id": f"{p}-{i}", "docNum": f"{i}/2024/QĐ", "issueDate": day(p) + "T00:00:00"} for i in range(4)]
        items = ([{"id": f"{p - 1}-3", "issueDate": day(p - 1)}] if p > 1 else []) + items
        body = [{"data": {"items": items}}, {"data": items}, {"items": [{"data": i} for i in items]}, {"data": {"data": items}}][p % 4]
        folder = tmp_path / "in" / f"page={p}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text(json.dumps(body), encoding="utf-8")
    return tmp_path / "in"


def ids(rows):
    return sorted(r["id"] for r in rows if r["id"])


def expected(pages):
    return sorted(f"{p}-{i}" for p in pages for i in range(4))


def test_reading_stops_at_the_page_that_crosses_the_cutoff(spark, landed):
    got = paged.scan(spark, str(landed), day(4)).collect()
    assert ids(got) == expected(range(1, 5)) and {r["page"] for r in got} == set(range(1, 5))
    assert {r["page"] for r in got if r["id"] == "1-3"} == {1}  # the repeated one counts where it came first
    assert str(got[0]["issued"]) >= day(4) and json.loads(got[0]["item"])["id"] == got[0]["id"]


def test_pages_after_the_crossing_one_are_not_opened(spark, landed):
    (landed / "page=7" / "part.txt").write_text("{broken")
    assert [r["error"] for r in paged.scan(spark, str(landed), day(4)).collect()] == [None] * 16
    whole = paged.scan(spark, str(landed)).collect()
    assert [r["page"] for r in whole if r["error"]] == [7] and ids(whole) == sorted([*expected([1, 2, 3, 4, 5, 6, 8, 9, 10]), "7-3"])


def test_cap_gap_and_dates(spark, landed):
    assert ids(paged.scan(spark, str(landed), cap=3).collect()) == expected([1, 2, 3])
    (landed / "page=2" / "part.txt").write_text(json.dumps({"data": [{"id": "x"}, {"id": "y", "issueDate": "29/02/2024"}, {"id": "z", "issueDate": "soon"}, "odd"]}))
    (landed / "page=3" / "part.txt").write_text('{"data": {"items": []}}')
    got = {r["id"]: str(r["issued"]) for r in paged.scan(spark, str(landed)).collect()}
    assert set(got) == {*expected([1]), "x", "y", "z"} and (got["x"], got["y"], got["z"]) == ("None", "2024-02-29", "None")
    assert paged.scan(spark, str(landed / "none")).collect() == []


def run(spark, folder, out, batches=None, **options):
    """Start the stream's query and stop it: after so many batches, or when there is nothing left."""
    spark.dataSource.register(paged.PagedSource)
    stream = spark.readStream.format("paged").options(path=str(folder), **options).load()
    q = stream.writeStream.format("parquet").option("path", f"{out}/o").option("checkpointLocation", f"{out}/c").trigger(processingTime="0 seconds" if batches is None else "1 second").start()
    if batches is None:
        q.processAllAvailable()
    else:
        while not q.lastProgress or q.lastProgress["batchId"] < batches - 1:
            q.awaitTermination(0.05)
    q.stop()
    progress = [p for p in q.recentProgress if p["sources"][0]["endOffset"]]
    return progress[-1]["sources"][0]["endOffset"] if progress else None


def test_a_stopped_stream_goes_on_with_the_next_page(spark, landed, tmp_path):
    run(spark, landed, str(tmp_path), batches=1, pages="2", cutoff=day(8))
    first = spark.read.parquet(f"{tmp_path}/o").select("page", "pos", "id").collect()
    assert 2 <= max(r["page"] for r in first) < 9
    end = run(spark, landed, str(tmp_path), pages="2", cutoff=day(8))
    rows = spark.read.parquet(f"{tmp_path}/o").select("page", "pos", "id").collect()
    assert len(rows) == len({(r["page"], r["pos"]) for r in rows}) and sorted({r["id"] for r in rows}) == expected(range(1, 9))
    assert paged.high_water(end) == day(1) and paged.high_water({"page": 3, "high": day(1), "over": False}, day(9)) == day(9)


def test_landed_pages_come_back(spark, tmp_path):
    df = spark.range(25).select((F.floor(F.col("id") / 10) + 1).alias("p"), "id", F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit("2024-01-01").alias("issueDate"))).alias("j"))
    path = paged.land(df, str(tmp_path / "l"), "p", "id", "j")
    assert [(r["page"], r["id"]) for r in paged.scan(spark, path).orderBy("page", "pos").collect()] == [(i // 10 + 1, str(i)) for i in range(25)]
