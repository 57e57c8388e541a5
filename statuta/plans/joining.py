"""Join, lookup and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators import graph, keys, ranking, rollups, similar
from statuta.plans.tables import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
WHERE (c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING') AND o_totalprice > 300000""")
def j01_filtered_join(t):
    """Equi-join under null-permissive filters."""
    c = t.customer.where("c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
    o = t.orders.where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey).drop("o_custkey")


@R.query("""
SELECT d.doc_id, quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j03_left(t):
    """Left join with a default."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 250000)")
def j04_anti(t):
    """Rows without a partner."""
    open_ = t.orders.where("o_orderstatus = 'P' AND o_totalprice > 250000")
    return t.customer.select("c_custkey").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@R.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j05_not_in(t):
    """Keys not in a set."""
    return t.documents.select("doc_id").join(t.labels.where("doc_id IS NOT NULL"), "doc_id", "left_anti")


@R.query("""
SELECT o_custkey % 1000 AS cited, count(*) AS n FROM orders
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey % 1000) GROUP BY 1""")
def j06_not_exists_group(t):
    """Numbers that are cited and missing, with counts."""
    c = t.orders.select((F.col("o_custkey") % 1000).alias("cited"))
    return rollups.missing(c, t.supplier.select(F.col("s_suppkey").alias("cited")), "cited")


@R.query("""
WITH refs AS (SELECT l_orderkey AS source, l_partkey::VARCHAR AS target, 'P' || l_suppkey AS number, CASE l_returnflag WHEN 'A' THEN 'Căn cứ' WHEN 'R' THEN 'Thay thế' ELSE 'N' END AS relation FROM lineitem),
src AS (SELECT o_orderkey AS source, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey::VARCHAR END AS ext, CASE WHEN o_orderstatus = 'F' THEN 1 END AS depth FROM orders),
known AS (SELECT p_partkey::VARCHAR AS target FROM part WHERE p_size <= 25),
q AS (SELECT o_orderkey::VARCHAR AS target, CASE WHEN o_orderkey % 5 = 0 THEN 'HUB_NOT_EXPANDED' ELSE 'PENDING' END AS state FROM orders WHERE o_orderpriority LIKE '1%')
SELECT target, number, min(relation) AS relation, count(*) AS in_degree, (min(coalesce(depth, 0)) + 1)::INT AS depth,
  round(3 * CASE min(relation) WHEN 'Thay thế' THEN 3.0 WHEN 'Căn cứ' THEN 1.0 ELSE 0.5 END + 2 * ln(1 + count(*)) - 1.5 * (min(coalesce(depth, 0)) + 1), 6) AS priority
FROM refs JOIN src USING (source)
WHERE target NOT IN (SELECT target FROM known) AND target NOT IN (SELECT target FROM q) AND ext NOT IN (SELECT target FROM q WHERE state = 'HUB_NOT_EXPANDED')
GROUP BY target, number""")
def j07_frontier_seed(t):
    """New crawl targets with priority; a null source id meets a non-empty hub set."""
    refs = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").cast("string").alias("target"), F.concat(F.lit("P"), "l_suppkey").alias("number"), F.when(F.col("l_returnflag") == "A", "Căn cứ").when(F.col("l_returnflag") == "R", "Thay thế").otherwise("N").alias("relation"))
    src = t.orders.select(F.col("o_orderkey").alias("source"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string")).alias("source_ext"), F.when(F.col("o_orderstatus") == "F", 1).alias("depth"))
    known = t.part.where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("target"))
    state = F.when(F.col("o_orderkey") % 5 == 0, "HUB_NOT_EXPANDED").otherwise("PENDING")
    queued = t.orders.where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").cast("string").alias("target"), state.alias("state"))
    f = graph.frontier(refs, src, known, queued)
    return f.withColumn("priority", F.round(graph.crawl_priority(graph.relation_weight(F.col("relation")), F.col("in_degree"), F.col("depth")), 6))


@R.query("""
SELECT DISTINCT a.label AS i, b.label AS j, (a.vec_id % 3) AS rel FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2
WHERE a.label <> b.label""")
def j09_edges(t):
    """Both ends looked up, self-loops dropped, distinct."""
    e = t.embeddings.select(F.col("label").alias("i"), F.floor(F.col("vec_id") / 2).alias("k"), (F.col("vec_id") % 3).alias("rel"))
    b = t.embeddings.select(F.col("vec_id").alias("k"), F.col("label").alias("j"))
    return e.join(b, "k").where("i <> j").select("i", "j", "rel").distinct()


@R.query("""
SELECT l_partkey, max(o_orderdate) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND p_size > 40 GROUP BY l_partkey ORDER BY latest DESC, l_partkey LIMIT 25""")
def j10_latest_distinct(t):
    """Distinct keys by their latest date."""
    j = t.lineitem.where("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_partkey").agg(F.max("o_orderdate").alias("latest")).orderBy(F.desc("latest"), "l_partkey").limit(25)


@R.query("""
WITH u AS (SELECT s_nationkey, max(s_name) AS s_name FROM supplier GROUP BY s_nationkey HAVING count(*) = 1)
SELECT c_custkey, coalesce(s.s_name, u.s_name) AS name FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN u ON u.s_nationkey = c_nationkey
WHERE coalesce(s.s_name, u.s_name) IS NOT NULL""")
def j12_lookup_fallback(t):
    """By key, else by a unique number, else dropped."""
    u = keys.unique_lookup(t.supplier, "s_nationkey", "s_name", "by_number").withColumnRenamed("s_nationkey", "_n")
    s = t.supplier.select("s_suppkey", F.col("s_name").alias("by_key"))
    j = t.customer.join(s, F.col("c_custkey") == F.col("s_suppkey"), "left").join(u, F.col("c_nationkey") == F.col("_n"), "left")
    return j.select("c_custkey", F.coalesce("by_key", "by_number").alias("name")).where("name IS NOT NULL")


@R.query("""
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def j14_hash_diff(t):
    """Two snapshots by digest; each is derived from documents by id on purpose."""
    d = t.documents.select("doc_id", "text")
    a = d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    b = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return keys.diff(a, b, ["doc_id"], ["h"])


@R.query("""
WITH a AS (SELECT o_custkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS k, min(o_orderstatus) AS rel FROM orders GROUP BY 1, 2),
b AS (SELECT o_custkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 50 END AS k, min(o_orderstatus) AS rel FROM orders WHERE o_totalprice > 100000 GROUP BY 1, 2)
SELECT coalesce(a.s, b.s) AS s, coalesce(a.k, b.k) AS k, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.rel = b.rel THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.s = b.s AND a.k IS NOT DISTINCT FROM b.k""")
def j15_edge_diff(t):
    """Edges with null-safe keys, added, removed or changed."""
    e = t.orders.select(F.col("o_custkey").alias("s"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 50).alias("k"), "o_orderstatus", "o_totalprice")
    a = e.groupBy("s", "k").agg(F.min("o_orderstatus").alias("rel"))
    b = e.where("o_totalprice > 100000").groupBy("s", "k").agg(F.min("o_orderstatus").alias("rel"))
    return keys.diff(a, b, ["s", "k"], ["rel"])


@R.query("""
WITH r AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 END AS b, o_custkey % 25 AS n FROM orders),
k AS (SELECT c_custkey AS target, c_custkey AS a, c_custkey % 100 AS b, c_nationkey AS n FROM customer WHERE c_acctbal > 0),
h AS (SELECT rid, min(target) AS target, 0 AS p FROM r JOIN k ON r.a = k.a GROUP BY rid UNION ALL SELECT rid, min(target), 1 FROM r JOIN k ON r.b = k.b GROUP BY rid
  UNION ALL SELECT rid, min(target), 2 FROM r JOIN k ON r.n = k.n GROUP BY rid)
SELECT rid, arg_min(target, p) AS target, (['id', 'second', 'number'])[min(p) + 1] AS step FROM h GROUP BY rid""")
def j16_entity_resolution(t):
    """Identity by the first key that matches."""
    o = F.col("o_orderkey")
    r = t.orders.select(o.alias("rid"), F.when(o % 4 == 0, F.col("o_custkey")).alias("a"), F.when(o % 3 == 0, F.col("o_custkey") % 100).alias("b"), (F.col("o_custkey") % 25).alias("n"))
    k = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("target"), (F.col("c_custkey") % 100).alias("kb"), F.col("c_nationkey").cast("long").alias("kn"))
    steps = [("id", F.col("a"), F.col("target")), ("second", F.col("b"), F.col("kb")), ("number", F.col("n"), F.col("kn"))]
    return keys.resolve(r, k, "rid", steps, "target")


@R.query("""
WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT c_custkey // 2 * 2 + (c_custkey % 10 = 1)::INT AS k, 'w' || c_custkey AS name, CASE WHEN c_acctbal > 0 THEN 'x' END AS seg FROM customer),
w1 AS (SELECT k, max(name) AS name, max(seg) AS seg FROM w GROUP BY k HAVING count(*) = 1)
SELECT s.k, coalesce(s.name, w1.name) AS name, coalesce(s.seg, w1.seg) AS seg, CASE WHEN w1.k IS NULL THEN 'strong' ELSE 'both' END AS origin FROM s LEFT JOIN w1 ON s.k = w1.k
UNION ALL SELECT k, name, seg, 'weak' FROM w1 WHERE k NOT IN (SELECT k FROM s) AND seg = 'x'""")
def j18_source_merge(t):
    """A strong source filled from the single weak row of its key."""
    c = F.col("c_custkey")
    s = t.customer.where("c_custkey % 3 <> 0").select(c.alias("k"), F.when(c % 2 == 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    w = t.customer.select((F.floor(c / 2) * 2 + (c % 10 == 1).cast("int")).alias("k"), F.concat(F.lit("w"), c).alias("name"), F.when(F.col("c_acctbal") > 0, "x").alias("seg"))
    return keys.merge_sources(s, w, "k", ["name", "seg"], F.col("seg") == "x")


@R.query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, list_distinct(list_filter(regexp_extract_all(lower(p_name), '\\w+'), lambda x: length(x) > 2)) AS k FROM part),
b AS (SELECT p_brand, p_type, min(p_partkey) AS ref FROM part GROUP BY 1, 2),
q AS (SELECT b.p_brand, b.p_type, k FROM b JOIN p ON p.p_partkey = b.ref),
s AS (SELECT p_partkey, p.p_brand, q.p_type AS qt, CASE WHEN least(len(p.k), len(q.k)) > 0 THEN len(list_intersect(p.k, q.k))::DOUBLE / least(len(p.k), len(q.k)) ELSE 0 END AS s FROM p JOIN q ON p.p_brand = q.p_brand),
r AS (SELECT *, row_number() OVER w AS n, s - lead(s) OVER w AS margin FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY s DESC, qt))
SELECT p_partkey, qt, round(s, 6) AS overlap FROM r WHERE n = 1 AND s >= 0.45 AND (margin IS NULL OR margin >= 0.15)""")
def j19_fuzzy_margin(t):
    """The candidate of most shared words, if clearly ahead. Candidates that matter share 0.3 at least: what is
    0.15 behind a best of 0.45 or more can't stand in its way."""
    p = t.part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("block"), similar.tokens(F.col("p_name")).alias("tokens"))
    first = t.part.groupBy("p_brand", "p_type").agg(F.min_by("p_name", "p_partkey").alias("ref"))
    ref = first.select(F.struct("p_brand", "p_type").alias("key"), F.col("p_brand").alias("block"), similar.tokens(F.col("ref")).alias("tokens"))
    s = similar.similar_pairs(p, ref, 0.3, within=True).select(F.col("a").alias("p_partkey"), F.col("b.p_type").alias("qt"), F.col("score").alias("s"))
    w = Window.partitionBy("p_partkey").orderBy(F.desc("s"), "qt")
    r = s.withColumn("n", F.row_number().over(w)).withColumn("margin", F.col("s") - F.lead("s").over(w))
    return r.where("n = 1 AND s >= 0.45 AND (margin IS NULL OR margin >= 0.15)").select("p_partkey", "qt", F.round("s", 6).alias("overlap"))


@R.query("""
WITH u AS (SELECT p_size, max(p_partkey) AS pk FROM part WHERE p_retailprice > 1200 GROUP BY p_size HAVING count(*) = 1),
c AS (SELECT p_size, count(*) AS n, count_if(p_brand LIKE '%1') AS nc, max(CASE WHEN p_brand LIKE '%1' THEN p_partkey END) AS pc FROM part GROUP BY p_size)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(i.p_partkey, u.pk, CASE WHEN nc = 1 THEN pc END) AS target FROM lineitem
LEFT JOIN part i ON i.p_partkey = l_partkey AND i.p_size <= 10 LEFT JOIN u ON u.p_size = l_quantity::INT LEFT JOIN c ON c.p_size = l_quantity::INT""")
def j20_edge_resolution(t):
    """By id, else by a unique number, else the single central one, else null."""
    q = F.col("l_quantity").cast("int")
    i = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("by_id"))
    u = keys.unique_lookup(t.part.where("p_retailprice > 1200"), "p_size", "p_partkey", "by_number").withColumnRenamed("p_size", "_u")
    c = keys.unique_lookup(t.part.where("p_brand LIKE '%1'"), "p_size", "p_partkey", "central").withColumnRenamed("p_size", "_c")
    j = t.lineitem.join(i, F.col("l_partkey") == F.col("by_id"), "left").join(u, q == F.col("_u"), "left").join(c, q == F.col("_c"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("by_id", "by_number", "central").alias("target"))


@R.query("SELECT n_chars, max(doc_id) AS doc_id FROM documents GROUP BY n_chars HAVING count(*) = 1")
def j31_unique_index(t):
    """Keys with exactly one row."""
    return keys.unique_lookup(t.documents, "n_chars", "doc_id")


@R.query("""
SELECT l_partkey, min(o_orderdate) AS first_hit, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A') AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_partkey""")
def j23_first_hit(t):
    """Affected keys, the first hit wins, rows of this run left out."""
    o = t.orders.join(t.orders.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", "left_anti")
    j = t.lineitem.where(F.col("l_returnflag").isin("R", "A")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_partkey").agg(F.min("o_orderdate").alias("first_hit"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@R.query("""
SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS by_whom FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey""")
def j24_reverse_lookup(t):
    """Who acts on a key, distinct."""
    e = t.lineitem.select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    a = graph.acting_on(e, ("R",), "by_whom")
    return a.select(F.col("node").alias("l_partkey"), F.array_join("by_whom", ",").alias("by_whom"))


@R.query("""
SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) OR d.doc_id IN (SELECT conv_id FROM conversations) AS known FROM documents d""")
def j25_gate(t):
    """Membership in the union of two sets."""
    known = t.labels.select("doc_id").union(t.conversations.select("conv_id")).distinct().withColumnRenamed("doc_id", "_k")
    return t.documents.join(known, F.col("doc_id") == F.col("_k"), "left").select("doc_id", F.col("_k").isNotNull().alias("known"))


@R.query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT s_suppkey AS node, dst AS other, 'forward' AS direction FROM supplier JOIN e ON src = s_suppkey
UNION ALL SELECT s_suppkey, src, 'backward' FROM supplier JOIN e ON dst = s_suppkey""")
def j26_both_ways(t):
    """Edges of a node in both directions, with labels."""
    e = t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    i = graph.impacts(e.withColumn("relation", F.lit("x")), t.supplier.select(F.col("s_suppkey").alias("node")))
    return i.select("node", "other", "direction")


@R.query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) WHERE r <= 4""")
def j27_semi_topk(t):
    """First rows of each key in a set."""
    o = t.orders.join(t.customer.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return ranking.first_of_each(o, "o_custkey", ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@R.query("""
SELECT l_partkey, min(coalesce((o_orderstatus = 'F')::INT, 0)) + 1 AS depth, count(DISTINCT l_suppkey) AS n_sources, count(DISTINCT (l_suppkey, o_custkey)) AS n_pairs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def j29_min_depth(t):
    """Smallest depth, distinct sources under two keys."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    depth = F.min(F.coalesce((F.col("o_orderstatus") == "F").cast("int"), F.lit(0))) + 1
    return j.groupBy("l_partkey").agg(depth.alias("depth"), F.countDistinct("l_suppkey").alias("n_sources"), F.countDistinct("l_suppkey", "o_custkey").alias("n_pairs"))


@R.query("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN NULL
  ELSE coalesce(CASE WHEN c_custkey % 9 = 0 THEN DATE '2020-01-01' END, DATE '2024-02-01') END AS delisted_at FROM customer""")
def j32_delist(t):
    """Rows not listed any more get the day, listed ones lose it."""
    c = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit("2020-01-01").cast("date")).alias("delisted_at"))
    seen = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return keys.delist(c, seen, "c_custkey", F.lit("2024-02-01").cast("date"))


@R.query("""
WITH ledger AS (SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE text END) AS h, doc_id % 10 <> 0 AS ok FROM documents WHERE doc_id % 4 <> 0)
SELECT d.doc_id, l.doc_id IS NULL OR sha256(d.text) <> l.h OR NOT l.ok AS redo FROM documents d LEFT JOIN ledger l ON d.doc_id = l.doc_id""")
def j17_ledger(t):
    """Work to redo: absent, changed or failed before."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    old = F.sha2(F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("text")), 256)
    led = t.documents.where("doc_id % 4 <> 0").select("doc_id", old.alias("h"), (F.col("doc_id") % 10 != 0).alias("ok"))
    return rollups.work_to_redo(d, led, "doc_id", "h", "ok").select("doc_id", "redo")


@R.query("SELECT l_suppkey FROM lineitem EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u03_difference(t):
    """Set difference."""
    return t.lineitem.select("l_suppkey").distinct().join(t.customer.where("c_acctbal > 0"), F.col("l_suppkey") == F.col("c_custkey"), "left_anti")


@R.query("""
SELECT user_id, list_min(list_intersect(list(DISTINCT k), [1, 2, 3, 5, 8, 13, 21])) AS code
FROM (SELECT user_id, (props->>'k')::INT AS k FROM events) GROUP BY user_id""")
def u04_intersect_min(t):
    """Smallest member of an intersection of code sets."""
    return rollups.smallest_common(t.events, "user_id", F.from_json("props", "k int")["k"], [1, 2, 3, 5, 8, 13, 21])


@R.query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def u06_distinct_edges(t):
    """Distinct edges."""
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").distinct()


@R.query("""
SELECT o_orderkey FROM orders WHERE (o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
AND (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01')
AND coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'O' END, true)""")
def p01_null_permissive_filters(t):
    """Conditions in which a null keeps the row."""
    d = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    flag = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "O")
    c = F.col("o_orderpriority").isNull() | ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t.orders.where(c & (d.isNull() | d.between(F.lit("1996-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp"))) & F.coalesce(flag, F.lit(True))).select("o_orderkey")


@R.query("""
SELECT doc_id, CASE WHEN source NOT IN ('src1', 'src2', 'src3', 'src4') THEN 'field' WHEN lang <> 'en' THEN 'scope' ELSE 'kept' END AS reason FROM documents""")
def p04_reason(t):
    """A whitelist with the reason of each exclusion."""
    return t.documents.select("doc_id", F.when(~F.col("source").isin("src1", "src2", "src3", "src4"), "field").when(F.col("lang") != "en", "scope").otherwise("kept").alias("reason"))


@R.query("SELECT doc_id FROM documents WHERE regexp_matches(lower(concat_ws(' ', text, source)), 'license|token|password') AND length(trim(text)) >= 200")
def p09_keyword_prefilter(t):
    """Any keyword, and text enough."""
    return t.documents.where(F.lower(F.concat_ws(" ", "text", "source")).rlike("license|token|password") & (F.length(F.trim("text")) >= 200)).select("doc_id")


@R.query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END, TIMESTAMP '2000-01-01') DESC, o_orderkey LIMIT 30""")
def p13_filter_before_limit(t):
    """Filter first, then the newest by a date with a fallback."""
    d = F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")), F.lit("2000-01-01").cast("timestamp"))
    return t.orders.where("o_orderstatus = 'O'").orderBy(d.desc(), "o_orderkey").limit(30).select("o_orderkey")
