"""Queries that run as streams over a table's files, with the SQL of the same table read at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.plans.tables import Registry
from statuta.session import shared_folder, written
from statuta.sources import paged, payloads, sinks
from statuta.streaming import keyed, scans

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _stream(t) -> DataFrame:
    """The events as a stream of files."""
    spark = t.events.sparkSession
    return spark.readStream.schema(t.events.schema).parquet(f"{t._folder}/events.parquet*")  # a glob: a lone file is no folder


def _ran(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    scans.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@R.query("""
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS old_status FROM events)
SELECT user_id, ts, old_status, event_type AS new_status FROM e WHERE old_status <> event_type AND ts < (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def x05_stream_changes(t):
    """Status changes of a stream by state and event-time timers; rows that the watermark has passed."""
    return _ran(keyed.status_changes(_stream(t), "user_id", "ts", "event_type", tie="event_id", lateness="0 seconds"))


@R.query("""
WITH e AS (SELECT user_id, ts, event_id::VARCHAR AS event_id, event_type || '/' || (event_id % 3) AS digest FROM events),
p AS (SELECT *, lag(digest) OVER w AS before, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ts, CASE WHEN r = 1 THEN 'new' ELSE 'changed' END AS kind, digest FROM p WHERE (r = 1 OR before <> digest) AND ts < (SELECT date_trunc('milliseconds', max(ts)) FROM events)""")
def m03_stream_arrivals(t):
    """Rows of a stream that are new, or changed since the key's row before."""
    digest = F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"))
    return _ran(keyed.arrivals(_stream(t).withColumn("digest", digest), "user_id", "ts", "digest", tie="event_id", lateness="0 seconds"))


def _pages(t) -> str:
    """The events as responses, newest first, about fifty pages; each page but the first repeats the last item before it."""
    size = max(1, t.events.count() // 50)
    e = sinks.positioned(t.events.select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], "r")
    item = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.concat("event_id", F.lit("/2024/QĐ")).alias("docNum"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("issueDate")))
    page = (F.floor(F.col("r") / size) + 1).cast("int")
    rows = e.select(F.explode(F.when(F.col("r") % size == size - 1, F.array(page, page + 1)).otherwise(F.array(page))).alias("p"), "r", item.alias("item"))
    return paged.land(rows, f"{shared_folder(t.events.sparkSession)}/pages-{uuid.uuid4().hex}", "p", "r", "item")


_PAGED = """
n AS (SELECT greatest(1, count(*) // 50) AS size FROM events),
p AS (SELECT event_id, ts::DATE AS issued, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) AS r FROM events),
q AS (SELECT event_id, issued, (r // size + 1)::INT AS page, r % size = size - 1 AS again FROM p, n),
c AS (SELECT least(40, coalesce(min(page), 40)) AS stop FROM (SELECT page, issued FROM q UNION ALL SELECT page + 1, issued FROM q WHERE again) WHERE issued < DATE '{}')
"""


@R.query("WITH " + _PAGED.format("2024-01-20") + "SELECT event_id::VARCHAR AS id, page, issued FROM q, c WHERE page <= stop AND issued >= DATE '2024-01-20'")
def s02_paged_scan(t):
    """A registry read page by page up to the page that crosses a cutoff, forty at most, each id once."""
    return paged.scan(t.events.sparkSession, _pages(t), "2024-01-20").select("id", "page", "issued")


@R.query("WITH " + _PAGED.format("2024-01-25") + "SELECT event_id::VARCHAR AS id, min(page) AS page, count(*) AS n FROM (SELECT event_id, page, issued FROM q UNION ALL SELECT event_id, page + 1, issued FROM q WHERE again), c WHERE page <= stop AND issued >= DATE '2024-01-25' GROUP BY event_id")
def s12_paged_stream(t):
    """The same pages as a stream that is stopped after a few pages and goes on: no page twice, none left out."""
    spark, path = t.events.sparkSession, _pages(t)
    spark.dataSource.register(paged.PagedSource)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.format("paged").options(path=path, cutoff="2024-01-25", pages="4").load()
    for once in (True, False):
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        if once:
            q.trigger(availableNow=True).start().awaitTermination()
        else:
            run = q.trigger(processingTime="0 seconds").start()
            run.processAllAvailable()
            run.stop()
    rows = spark.read.schema(paged.SCHEMA).parquet(f"{folder}/out")
    return rows.groupBy("id").agg(F.min("page").alias("page"), F.count("*").alias("n"))


def _landed(df: DataFrame, name: str, **options) -> str:
    """Where rows of text were written, a folder a value of the other column if there is one."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(*[c for c in df.columns if c != "value"]) if len(df.columns) > 1 else writer).text(path)
    return path


@R.query("""
SELECT event_id::VARCHAR AS tvpl_id, 'van-ban-' || event_type || '-x' AS slug, event_type AS category, ts::DATE AS pub_date FROM events
WHERE event_type IN ('purchase', 'error') AND event_id % 7 <> 0""")
def s05_feed(t):
    """Entries of landed feeds whose address or category names a field; an entry without an id goes."""
    e, lit = t.events, F.lit
    link = F.concat(lit("https://x/van-ban/"), F.upper("event_type"), lit("/van-ban-"), "event_type", lit("-x"), F.when(F.col("event_id") % 7 != 0, F.concat(lit("-"), "event_id", lit(".aspx"))).otherwise(".html"))
    day = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0700'")
    item = F.concat(lit("<item><title>Mẫu &amp; "), "event_id", lit("</title><link>"), link, lit("</link><category>"), "event_type", lit("</category><pubDate>"), day, lit("</pubDate></item>"))
    feeds = max(1, e.count() // 200)
    lists = e.groupBy((F.col("event_id") % feeds).alias("feed")).agg(F.array_join(F.collect_list(item), "\n").alias("items"))  # two hundred a feed
    files = lists.select("feed", F.concat(lit("<rss><channel>"), "items", lit("</channel></rss>")).alias("value"))
    got = payloads.feeds(written(files.select("value"), "feed"), ["Purchase", "ERROR"])
    return got.select("tvpl_id", "slug", "category", "pub_date")


@R.query("""
SELECT CASE WHEN s_suppkey % 6 = 1 THEN 'a-' || s_suppkey ELSE 's' || s_suppkey END AS slug, s_name AS num, CASE WHEN s_acctbal < 0 THEN 'het_toan_bo' ELSE 'con_hieu_luc' END AS state, 'r' || s_nationkey AS refs
FROM supplier WHERE s_suppkey % 6 NOT IN (0, 2, 3)""")
def s10_vault_index(t):
    """Rows of published indexes, a file for each of 25 nations; entries without a slug or with one that leaves the folder go."""
    k, lit = F.col("s_suppkey"), F.lit
    key = k.cast("string")
    slug = F.when(k % 6 == 0, F.concat(lit("../"), key)).when(k % 6 == 1, F.concat(lit("a-"), key)).when(k % 6 == 2, F.concat(lit("a/"), key)).when(k % 6 != 3, F.concat(lit("s"), key))
    state = F.when(F.col("s_acctbal") < 0, "het_toan_bo").otherwise("con_hieu_luc")
    row = F.struct(slug.alias("slug"), F.col("s_name").alias("num"), state.alias("state"), F.array(F.concat(lit("r"), "s_nationkey")).alias("refs"))
    files = t.supplier.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("documents"))).alias("value"))  # 25 files, as they are published
    got = payloads.vault_index(t.supplier.sparkSession, _landed(files, "vault"))
    return got.select("slug", "num", "state", F.array_join("refs", ",").alias("refs"))
