"""Landed payloads, sinks and streams on small files."""

import json

from pyspark.sql import functions as F

from statuta.sources import payloads, sinks
from statuta.streaming import scans


def test_registry_layouts(spark, tmp_path):
    item = {"id": "1", "docNum": "1/2024/QH15", "issueDate": "01/02/2024", "agencyName": None, "organization": {"name": "Quốc hội"},
            "references": [{"referenceType": 12, "targetDocument": {"docNum": "2/2020/QH14", "id": "9"}}, {"referenceType": 8, "targetDocNum": "x"}, {"referenceType": 1, "targetDocNum": " "}]}
    (tmp_path / "a.json").write_text(json.dumps({"data": {"items": [item, {**item, "id": "2"}]}}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"data": {**item, "id": "3", "documentContent": {"content": "<p>x</p>"}}}), encoding="utf-8")
    items = payloads.registry(spark, str(tmp_path))
    rows = {r["moj_id"]: r for r in payloads.document_rows(items).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["3"]["html"] == "<p>x</p>" and rows["1"]["agency_name"] == "Quốc hội" and str(rows["1"]["issue_date"]) == "2024-02-01"
    refs = [(r["target_doc_num"], r["relation"]) for r in payloads.reference_rows(items.where("id = '1'")).collect()]
    assert refs == [("2/2020/QH14", "Thay thế"), ("x", "Chưa xác định (mã 8)")]
    assert payloads.incremental(items.unionAll(items), F.lit("2024-01-01").cast("date")).count() == 3
    assert payloads.incremental(items, F.lit("2025-01-01").cast("date")).count() == 0


def test_feed_and_chunk_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>t</title><link>https://x/van-ban/Thue/abc-def-123.aspx</link><category>Thue</category><pubDate>Wed, 22 Jul 2026 00:00:00 +0700</pubDate></item>"
        "<item><title>u</title><link>https://x/no-id</link><category>Thue</category><pubDate></pubDate></item></channel></rss>"
    )
    got = payloads.feed(spark, str(tmp_path / "f.xml"), ["thue"]).collect()
    assert [(r["tvpl_id"], r["slug"]) for r in got] == [("123", "abc-def")] and str(got[0]["pub_date"]).startswith("2026-07-2")
    (tmp_path / "55_chunks.json").write_text(json.dumps([{"chunk_index": 0, "heading": "h", "content": "c"}]))
    assert payloads.chunk_files(spark, str(tmp_path / "55_chunks.json")).first()["moj_id"] == "55"


def test_text_falls_back_and_index_guards_paths(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), (None, "y"), ("q", "z")], "moj string, num string")
    texts = spark.createDataFrame([("a", "A"), ("y", "Y")], "name string, text string")
    assert {r["num"]: r["text"] for r in payloads.text_with_fallbacks(docs, texts, ["moj", "num"]).collect()} == {"x": "A", "y": "Y", "z": None}
    (tmp_path / "i.json").write_text(json.dumps({"documents": [{"slug": "ok"}, {"slug": "../etc"}, {}]}))
    assert [r["slug"] for r in payloads.vault_index(spark, str(tmp_path / "i.json")).collect()] == ["ok"]


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "k int, body string")
    old = sinks.changed_pages(pages, pages.limit(0).select("k", F.lit("").alias("digest")), "k", "body").select("k", "digest")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c")], "k int, body string")
    assert {r["k"]: r["action"] for r in sinks.changed_pages(new, old, "k", "body").collect()} == {1: "same", 2: "changed", 3: "new"}
    assert [r["k"] for r in sinks.orphans(old, pages.where("k = 1"), "k").collect()] == [2] and sinks.orphans(old, pages.limit(0), "k").count() == 0
    path = str(tmp_path / "v")
    for version, n in (("a", 3), ("b", 2), ("a", 1)):
        sinks.overwrite_version(spark.range(n).withColumn("scorer_version", F.lit(version)), path)
    assert {r["scorer_version"]: r["n"] for r in spark.read.parquet(path).groupBy("scorer_version").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 2}
    assert [r["i"] for r in sinks.positioned(spark.range(50), [F.desc("id")], "i").orderBy("id").collect()] == list(range(49, -1, -1))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:00:00", "A"), (1, "2024-01-02 00:00:00", "B"), (2, "2024-01-01 00:00:00", "A"), (1, "2024-01-03 00:00:00", "B")]
    df = spark.createDataFrame(rows, "k long, t string, s string").withColumn("t", F.to_timestamp("t"))
    scans.land_snapshot(df.unionAll(df.where("k = 2")), src, "x", "2024-01-03")
    stream = lambda: spark.readStream.schema(df.schema).parquet(src + "/*/*")
    scans.run_available(scans.stream_latest(stream(), ["k", "t"], "t"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 4
    scans.run_available(scans.stream_latest(stream(), ["k", "t"], "t"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 4  # nothing new has landed


def test_feeds_of_a_table(spark, tmp_path):
    """What files of a feed each give, a table with a feed a row gives, too; of one that breaks off the whole entries."""
    item = "<item><title>a &amp; b\n</title><link>https://x/van-ban/Thue/ab-{}.aspx</link><category>{}</category><pubDate>Wed, 22 Jul 2026 00:00:00 +0700</pubDate></item>"
    texts = [f"<rss><channel>{item.format(n, 'Thue')}\n{item.format(n + 1, 'Khac &lt;x&gt;')}</channel></rss>" for n in (10, 20, 30)]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.xml").write_text(t)
    told = lambda df: sorted((r["tvpl_id"], r["slug"], r["title"], r["category"], str(r["pub_date"])) for r in df.collect())
    table = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    want = told(payloads.feed(spark, str(tmp_path), ["thue"]))
    assert told(payloads.feeds(table, ["thue"])) == want and len(want) == 6
    odd = [(f'<rss><channel><item id="1">{item.format(7, "Thue")[6:]}<item><title>cut',), (None,), ("",), ("<rss/>",)]
    assert [r[0] for r in told(payloads.feeds(spark.createDataFrame(odd, "value string"), ["thue"]))] == ["7"]
