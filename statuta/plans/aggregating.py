"""Aggregation queries and rule queries of jobs, forms and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions.values import quarter_label
from statuta.operators import jobs, keys, ranking, rollups
from statuta.plans.tables import Registry
from statuta.streaming import scans

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("SELECT count(DISTINCT l_partkey) AS n_targets, count(*) AS n_rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30)")
def a02_unresolved(t):
    """A2, A3: distinct numbers that can't be resolved."""
    u = t.lineitem.join(t.part.where("p_size < 30"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    return u.agg(F.countDistinct("l_partkey").alias("n_targets"), F.count("*").alias("n_rows"))


@R.query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a04_duplicates(t):
    """A4: keys met more than once."""
    return rollups.repeated(t.lineitem, ["l_orderkey", "l_partkey"])


@R.query("SELECT event_type, CASE WHEN coalesce(max((props->>'k')::INT), 0) = 0 THEN 1 ELSE max((props->>'k')::INT) END AS most FROM events GROUP BY 1")
def a05_max_or_one(t):
    """A5: a maximum that is 1 when null or 0."""
    return t.events.groupBy("event_type").agg(rollups.maximum_or_one(F.from_json("props", "k int")["k"]).alias("most"))


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def a06_state_counts(t):
    """Counts by state and kind."""
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@R.query("""
SELECT o_custkey, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'P') AS p, count_if(o_orderstatus = 'X') AS x FROM orders GROUP BY 1""")
def a07_pivot_states(t):
    """A column a state, zero where there is none."""
    p = rollups.pivoted(t.orders, "o_custkey", "o_orderstatus", ["F", "P", "X"])
    return p.select("o_custkey", F.col("F").alias("f"), F.col("P").alias("p"), F.col("X").alias("x"))


@R.query("""
SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct([event_type, 'k' || ((props->>'k')::INT % 4)])) AS tag FROM events) GROUP BY tag""")
def a08_explode_count(t):
    """Rows counted once in each of their groups."""
    k = F.from_json("props", "k int")["k"] % 4
    return rollups.counted_in_each(t.events, F.array("event_type", F.concat(F.lit("k"), k.cast("string"))))


@R.query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang, n FROM g WHERE (SELECT count(*) FROM g) >= 3 ORDER BY n DESC, lang LIMIT 7""")
def a10_top_groups(t):
    """Largest groups, none if there are fewer than three."""
    return rollups.largest_groups(t.documents, "lang", 7, least=3)


@R.query("""
SELECT strftime(o_orderdate, '%m/%y') AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'
GROUP BY strftime(o_orderdate, '%m/%y'), year(o_orderdate), month(o_orderdate) HAVING count(*) >= 4 ORDER BY year(o_orderdate), month(o_orderdate) LIMIT 8""")
def a12_month_calendar(t):
    """The next months in order of the calendar."""
    return rollups.months(t.orders, "o_orderdate", F.lit("2000-06-01").cast("timestamp"), 4, 8)


@R.query("""
SELECT n_name, round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS share FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 8""")
def a13_share_top(t):
    """Largest shares of the whole."""
    n = F.broadcast(t.nation)  # 25 rows
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rollups.largest_shares(j, "n_name", "o_totalprice", 8, 4)


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, round(100 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS pct FROM lineitem")
def a20_share(t):
    """Parts of 100 in each unit."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(ranking.share_of("l_quantity", "l_orderkey"), 6).alias("pct"))


@R.query("""
SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS keys, min(l_linenumber) AS lowest, max(l_quantity) AS highest,
  arg_min(l_shipdate, (l_orderkey, l_linenumber, l_shipdate)) AS first_reason FROM lineitem GROUP BY l_suppkey""")
def a21_group_rollup(t):
    """Sorted keys, minimum, maximum and the first reason of a group."""
    return rollups.rollup(t.lineitem, "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity", "l_shipdate", ["l_orderkey", "l_linenumber", "l_shipdate"])


@R.query("""
SELECT n_nationkey, arg_max(c_custkey, (round(c_acctbal, 1), -c_custkey)) AS c_custkey, max(round(c_acctbal, 1)) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_nationkey HAVING max(round(c_acctbal, 1)) >= 9000""")
def a22_argmax(t):
    """The row of the largest rounded value, then a threshold on it."""
    j = t.customer.join(F.broadcast(t.nation.select("n_nationkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    return rollups.best_rows(j, "n_nationkey", "c_acctbal", "c_custkey", 1, 9000)


@R.query("""
WITH b AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2),
t AS (SELECT o_custkey, list(o_orderpriority ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, o_orderpriority) AS r FROM b) WHERE r <= 2 GROUP BY 1)
SELECT count(*) AS n, round(avg(list_contains(top, '1-URGENT')::INT), 6) AS hit_rate, round(avg((NOT list_has_any(top, ['2-HIGH', '3-MEDIUM']))::INT), 6) AS violation_rate FROM t""")
def a24_quality_rates(t):
    """Hit rate of an expected code in the top two, rate of no overlap with allowed ones."""
    b = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return rollups.quality_rates(b, "o_custkey", "o_orderpriority", "s", 2, "1-URGENT", ["2-HIGH", "3-MEDIUM"], 6)


@R.query("""
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, arg_max(o_orderstatus, (n, o_orderstatus)) AS dominant, round(max(n)::DOUBLE / sum(n)::DOUBLE, 6) AS share FROM c GROUP BY 1""")
def a25_dominant_share(t):
    """A histogram per code and its dominant value's share."""
    return rollups.dominant(t.orders, "o_orderpriority", "o_orderstatus", 6)


@R.query("""
WITH p AS (SELECT quality, (n_chars > 1500)::INT AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count_if(pred = 1 AND quality = 1)::DOUBLE AS tp, count_if(pred = 1 AND quality = 0)::DOUBLE AS fp, count_if(pred = 0 AND quality = 1)::DOUBLE AS fn FROM p)
SELECT round(tp / (tp + fp), 6) AS prec, round(tp / (tp + fn), 6) AS rec, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def a26_prf1(t):
    """Precision, recall and F1 of a predicate."""
    p = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rollups.precision_recall(p, F.col("n_chars") > 1500, F.col("quality") == 1, 6)


@R.query("""
WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT source, n, least(n, greatest(4, floor(200 * sqrt(n) / sum(sqrt(n)) OVER ())::BIGINT)) AS quota FROM g""")
def a27_sqrt_quota(t):
    """Quotas by the root of the size, 4 at least, the size at most."""
    return rollups.root_quotas(t.documents, "source", 200, 4)


@R.query("SELECT o_orderstatus, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderstatus")
def a29_distribution(t):
    """Counts with shares of the whole."""
    return rollups.distribution(t.orders, "o_orderstatus", 4)


@R.query("SELECT sum(n - 1)::BIGINT AS extra FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_returnflag HAVING count(*) > 1)")
def a32_duplication(t):
    """Surplus rows over a key of four."""
    return rollups.surplus(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])


@R.query("""
SELECT o_orderpriority, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, count(*) AS n FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 GROUP BY 1, 2 HAVING count(*) >= 5""")
def a34_quarterly_eligible(t):
    """Top rows by quarter, groups of five at least."""
    top = ranking.first_of_each(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"])
    return top.groupBy("o_orderpriority", quarter_label(F.col("o_orderdate")).alias("q")).agg(F.count("*").alias("n")).where("n >= 5")


def _changes(t):
    """Two snapshots of customers for the upsert queries."""
    c = F.col("c_custkey")
    cur = t.customer.where("c_custkey % 5 <> 0").select(c.alias("k"), F.when(c % 3 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("status"), (c % 2 == 0).alias("flag"))
    new = t.customer.where("c_custkey % 4 <> 0").select(c.alias("k"), F.concat(F.lit("n"), c).alias("name"), F.when(c % 7 == 0, "CHANGED").when(c % 11 != 0, F.col("c_mktsegment")).alias("status"), (c % 6 == 0).alias("flag"))
    return cur, new


_UPSERT = """
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_mktsegment AS status, c_custkey % 2 = 0 AS flag FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS k, 'n' || c_custkey AS name, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS status, c_custkey % 6 = 0 AS flag FROM customer WHERE c_custkey % 4 <> 0)
"""


@R.query(_UPSERT + """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.name IS NULL OR a.name = '' THEN coalesce(b.name, a.name) ELSE a.name END AS name,
coalesce(b.status, a.status) AS status, coalesce(a.flag, false) OR coalesce(b.flag, false) AS flag, a.k IS NULL AS is_new FROM a FULL JOIN b ON a.k = b.k""")
def m01_upsert(t):
    """Nulls never overwrite; fill, refresh and sticky columns."""
    return keys.upsert(*_changes(t), "k", refresh=["status"], fill=["name"], sticky=["flag"])[0]


@R.query(_UPSERT + "SELECT a.k, a.status AS old_value, b.status AS new_value FROM a JOIN b ON a.k = b.k WHERE b.status IS NOT NULL AND a.status IS DISTINCT FROM b.status")
def m03_status_history(t):
    """Rows of the tracked column that changed."""
    return keys.upsert(*_changes(t), "k", refresh=["status"], fill=["name"], sticky=["flag"], tracked="status")[1]


@R.query("""
WITH a AS (SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::VARCHAR END, 'num' || o_custkey) AS k, o_orderkey % 4 AS i, max(o_totalprice) AS price, count(*) AS used FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
b AS (SELECT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::VARCHAR END, 'num' || o_custkey) AS k, o_orderkey % 4 AS i, max(o_totalprice) AS price, count(*) AS used FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(b.k, a.k) AS k, coalesce(b.i, a.i) AS i, coalesce(b.price, a.price) AS price, coalesce(a.used, b.used) AS used FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i""")
def k02_merge(t):
    """K2, K3, K7, K9: rows replaced on a coalesced key, usage kept."""
    k = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")), F.concat(F.lit("num"), "o_custkey")).alias("k")
    s = lambda st: t.orders.where(F.col("o_orderstatus") == st).groupBy(k, (F.col("o_orderkey") % 4).alias("i")).agg(F.max("o_totalprice").alias("price"), F.count("*").alias("used"))
    return keys.upsert_coalesced(s("F"), s("O"), [F.col("k"), F.col("i")], ["k", "i", "price", "used"], ["used"])


@R.query("""
SELECT o_orderkey, lvl <= 5 OR o_orderstatus = 'P' OR x >= 60 AS worth, CASE WHEN lvl <= 5 THEN 'cap_hieu_luc_' || lvl WHEN o_orderstatus = 'P' THEN 'doi_trang_thai_hieu_luc'
WHEN x >= 60 THEN 'cuong_do_' || x ELSE 'duoi_nguong (cap ' || lvl || ', cuong do ' || x || ')' END AS reason
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE left(o_orderpriority, 1)::INT + 3 END AS lvl, o_custkey % 100 AS x FROM orders)""")
def m05_materiality(t):
    """M5: worth a report by level, status change or intensity, with the reason."""
    level = F.when(F.col("o_orderkey") % 11 != 0, F.substring("o_orderpriority", 1, 1).cast("int") + 3)
    m = jobs.materiality(level, F.col("o_orderstatus") == "P", F.col("o_custkey") % 100)
    return t.orders.select("o_orderkey", m.alias("m")).select("o_orderkey", "m.worth", "m.reason")


@R.query("""
WITH c AS (SELECT DISTINCT user_id AS code, user_id % 10 AS level FROM events), busy AS (SELECT DISTINCT user_id AS code FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-24')
SELECT code, level FROM c WHERE code NOT IN (SELECT code FROM busy) OR level <= 3""")
def m06_cooldown(t):
    """M6: candidates without a recent job, or of a level that needs no pause."""
    c = t.events.select(F.col("user_id").alias("code"), (F.col("user_id") % 10).alias("level")).distinct()
    j = t.events.select(F.col("user_id").alias("code"), F.when(F.col("event_type") == "purchase", "b").alias("kind"), F.lit("DONE").alias("status"), F.col("ts").alias("created_at"))
    return jobs.out_of_cooldown(c, j, F.lit("2024-01-31").cast("date"))


@R.query("""
WITH RECURSIVE e AS (SELECT ts::DATE AS day, event_id AS ord, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS r FROM events WHERE event_type = 'signup'),
o AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
c AS (SELECT greatest(1, (SELECT count(*) FROM e) // 28 + coalesce((SELECT max(n) FROM o), 0)) AS cap),
b AS (SELECT min(day) AS lo, max(day) AS hi FROM (SELECT day FROM e UNION ALL SELECT day FROM o)),
d AS (SELECT lo + i::INT AS day, i FROM (SELECT lo, unnest(range(0, date_diff('day', lo, hi) + 9)) AS i FROM b)),
n AS (SELECT list(coalesce(x, 0) ORDER BY i) AS new, list(coalesce(y, 0) ORDER BY i) AS used, count(*) - 8 AS days FROM (SELECT i, (SELECT count(*) FROM e WHERE e.day = d.day) AS x, (SELECT n FROM o WHERE o.day = d.day) AS y FROM d)),
s(k, used, rest, take) AS (SELECT -1::BIGINT, used, 0::BIGINT, 0::BIGINT FROM n UNION ALL
  SELECT k, list_concat(list_concat(used[1:j - 1], [used[j] + t]), used[j + 1:]), l - t, t FROM (SELECT k, used, j, l, least(l, greatest(0, cap - used[j])) AS t, days FROM
  (SELECT s.k + 1 AS k, s.used AS used, (s.k + 1) // 8 + (s.k + 1) % 8 + 1 AS j, CASE WHEN (s.k + 1) % 8 = 0 THEN n.new[(s.k + 1) // 8 + 1] ELSE rest END AS l, cap, days FROM s, n, c)) WHERE k < 8 * days),
p AS (SELECT lo + (k // 8)::INT AS day, lo + (k // 8 + k % 8)::INT AS scheduled_for, take, coalesce(sum(take) OVER (PARTITION BY k // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up FROM s, b WHERE k >= 0)
SELECT e.day, ord, ord::VARCHAR AS key, scheduled_for FROM e LEFT JOIN p ON p.day = e.day AND r > up AND r <= up + take""")
def m07_daily_cap(t):
    """Every job gets the first day with room within a week."""
    e = t.events.where("event_type = 'signup'").select(F.to_date("ts").alias("day"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("key"))
    old = t.events.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return jobs.schedule(e, old, cap=max(1, e.count() // 28 + old.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]))


@R.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'het_hieu_luc' WHEN l_quantity > 40 THEN 'co_ban_thay_the' WHEN l_returnflag = 'R' THEN 'can_kiem_tra' WHEN l_tax > 0.05 THEN 'khong_ro' ELSE 'con_hieu_luc' END AS s FROM lineitem),
p AS (SELECT *, list_position(['het_hieu_luc', 'co_ban_thay_the', 'can_kiem_tra', 'khong_ro', 'con_hieu_luc'], s) AS k FROM r)
SELECT l_orderkey, arg_min(s, (k, l_linenumber)) AS state, count(*) AS n_refs FROM p GROUP BY l_orderkey""")
def m10_worst_wins(t):
    """The worst reference decides a form's state."""
    by = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    state = F.when(F.col("l_returnflag") == "A", "het_toan_bo").when(F.col("l_tax") > 0.05, "khong_ro").otherwise("con_hieu_luc")
    s = jobs.reference_state(state, by(F.col("l_quantity") > 40), by(F.col("l_returnflag") == "R"))
    return jobs.worst_wins(t.lineitem.select("l_orderkey", "l_linenumber", s.alias("s")), "l_orderkey", "s", "l_linenumber")


@R.query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-10') WHERE r = 1")
def x02_cutoff(t):
    """The latest row of a key since the cutoff."""
    return scans.new_rows(t.events, "user_id", "ts", F.lit("2024-01-10").cast("timestamp")).select("event_id", "user_id", "ts")


@R.query("""
SELECT event_id, user_id, old_status, event_type AS new_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status FROM events) WHERE old_status <> event_type""")
def x05_status_change(t):
    """Rows whose status differs from the row before."""
    return scans.status_changes(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "old_status", "new_status")


@R.query("""
WITH m AS (SELECT event_type, min(ts) AS high_water FROM events WHERE user_id % 2 = 0 GROUP BY 1), s AS (SELECT event_type, max(ts) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT coalesce(m.event_type, s.event_type) AS event_type, greatest(high_water, n) AS high_water FROM m FULL JOIN s ON m.event_type = s.event_type""")
def x01_high_water(t):
    """Marks that never move back."""
    marks = t.events.where("user_id % 2 = 0").groupBy("event_type").agg(F.min("ts").alias("high_water"))
    return scans.advanced(marks, t.events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), "event_type", "ts")
