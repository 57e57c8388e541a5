"""Top-1 and top-k per group, percentile ranks and other ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.operators.impact import percentile_vs_reference
from statuta.operators import ranking
from statuta.operators.jobs import budget_batches
from statuta.plans.tables import Registry
from statuta.sources.sinks import positioned

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
SELECT n_name, count(*) AS n_customers, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / (100 * count(*)) AS avg_top
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE rn = 1 GROUP BY n_name""")
def w01_top1_per_group(t):
    """Each customer's largest order, rolled up by nation; sums in cents, so that any order of rows gives the same."""
    best = F.max_by(F.struct("o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    top = t.orders.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_totalprice")
    j = top.join(t.customer, top.o_custkey == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return j.groupBy("n_name").agg(F.count("*").alias("n_customers"), (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / (100 * F.count("*"))).alias("avg_top"))


@R.query("""
SELECT o_orderkey, o_orderpriority, round(CASE WHEN n > 0 THEN 100.0::DOUBLE * upto / n ELSE 0 END, 6) AS pct
FROM (SELECT *, sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS upto,
  sum((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""")
def w02_percentile_vs_reference(t):
    """Percentile of every order against finished ones of its priority."""
    r = percentile_vs_reference(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F", "pct")
    return r.select("o_orderkey", "o_orderpriority", F.round("pct", 6).alias("pct"))


@R.query("""
SELECT o_custkey, o_orderkey, o_totalprice, rn AS place FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 3""")
def w04_top3(t):
    """Three largest orders of each customer."""
    return ranking.first_of_each(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@R.query("""
SELECT o_custkey, o_orderkey, round(o_totalprice - nxt, 4) AS margin FROM
(SELECT *, row_number() OVER w AS rn, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn = 1""")
def w05_margin(t):
    """Lead of the best over the runner-up."""
    return ranking.margin(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", F.round("margin", 4).alias("margin"))


@R.query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS idx
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10)""")
def w06_reindex(t):
    """Positions from 0 after rows are dropped."""
    k = t.lineitem.where("l_quantity >= 10").select("l_orderkey", "l_linenumber").distinct()
    return ranking.reindexed(k, "l_orderkey", ["l_linenumber"])


@R.query("""
SELECT vec_id, label FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 100) = 0 ORDER BY vec_id LIMIT 100""")
def w07_systematic_sample(t):
    """A sampling operator, every n-th id up to 100 rows."""
    return ranking.systematic_sample(t.embeddings.select("vec_id", "label"), "vec_id", 100)


@R.query("""
WITH RECURSIVE l AS (SELECT doc_id, length(x) AS n, i FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
f(doc_id, i, used, batch, n) AS (SELECT doc_id, i, n, 0, n FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, CASE WHEN used + l.n > 1000 THEN l.n ELSE used + l.n END, batch + (used + l.n > 1000)::INT, l.n FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, batch, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM f GROUP BY 1, 2""")
def w08_budget_packing(t):
    """Lines of each document in batches of at most 1000 characters, in order; a longer line alone."""
    lines = t.documents.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.length(x))).alias("line", "size"))
    b = budget_batches(lines, "doc_id", ["line"], "size", 1000)
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("n_lines"), F.sum("size").alias("n_chars"))


@R.query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS idx FROM customer")
def w09_positional_index(t):
    """Positions of all customers by name."""
    return positioned(t.customer.select("c_custkey", "c_name"), [F.col("c_name"), F.col("c_custkey")], "idx").select("c_custkey", "idx")


@R.query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 50")
def t01_topk(t):
    """The next batch by priority, then age."""
    return t.orders.where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "o_orderdate")


@R.query("""
SELECT o_orderkey, o_orderstatus FROM orders
ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC LIMIT 40""")
def t03_case_order(t):
    """Running first, then queued, then the rest; newest first."""
    rank = ranking.case_rank(F.col("o_orderstatus"), "P", "O")
    return t.orders.select("o_orderkey", "o_orderstatus").orderBy(rank, F.desc("o_orderkey")).limit(40)


@R.query("""
SELECT p_partkey, 2 * (p_name ILIKE '%a%')::INT + 4 * (p_size > 25)::INT + (p_brand IS NOT NULL)::INT AS points FROM part
WHERE p_retailprice >= 900 ORDER BY points DESC, p_partkey LIMIT 30""")
def t07_candidate_ranking(t):
    """Points for each property, ties by key."""
    points = ranking.points((F.col("p_name").ilike("%a%"), 2), (F.col("p_size") > 25, 4), (F.col("p_brand").isNotNull(), 1))
    return t.part.where("p_retailprice >= 900").select("p_partkey", points.alias("points")).orderBy(F.desc("points"), "p_partkey").limit(30)


@R.query("""
SELECT l_orderkey, l_partkey, l_linenumber, round(share, 6) AS share FROM
(SELECT *, 100 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem) WHERE share >= 40""")
def t08_large_shares(t):
    """Lines that make up a stated share of their order."""
    share = ranking.share_of("l_extendedprice", "l_orderkey")
    return t.lineitem.withColumn("share", share).where("share >= 40").select("l_orderkey", "l_partkey", "l_linenumber", F.round("share", 6).alias("share"))


@R.query("""
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY o_custkey""")
def t09_in_order(t):
    """All keys of a group joined in order."""
    return ranking.joined_in_order(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", ",", "keys")


@R.query("""
SELECT event_id, user_id, ts FROM (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r
FROM events WHERE list_contains(['purchase', 'signup'], event_type)) WHERE r <= 5""")
def t10_group_listing(t):
    """Newest rows of a group by membership."""
    e = t.events.where(F.array_contains(F.array(F.lit("purchase"), F.lit("signup")), F.col("event_type")))
    return ranking.first_of_each(e, "user_id", [F.desc("ts"), "event_id"], 5).select("event_id", "user_id", "ts")