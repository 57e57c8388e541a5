"""Composite queries: report jobs, forms, nested payloads, exports, payload parsing, queues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators import forms, jobs, rollups
from statuta.plans.tables import Registry
from statuta.sources import payloads, sinks

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
WITH i AS (SELECT l_orderkey AS doc, l_suppkey % 20 AS code, max(l_quantity * 2) AS x FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY x DESC, code) AS r FROM i),
d AS (SELECT o_orderkey AS doc, left(o_orderpriority, 1)::INT + 3 AS level, o_orderstatus = 'P' AS changed FROM orders WHERE o_totalprice > 150000),
b AS (SELECT doc, max(x) AS best FROM t WHERE r <= 3 GROUP BY doc),
m AS (SELECT d.*, coalesce(best, 0) AS best FROM d LEFT JOIN b USING (doc)), w AS (SELECT * FROM m WHERE level <= 5 OR changed OR best >= 60)
SELECT coalesce(t.code, -1) AS code, count(DISTINCT w.doc) AS n_docs, min(level) AS level, round(max(coalesce(t.x, 0)), 4) AS intensity, min(w.doc) AS first_doc
FROM w LEFT JOIN t ON t.doc = w.doc AND r <= 3 GROUP BY 1""")
def m08_update_jobs(t):
    """Material documents grouped by their top industries."""
    i = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 20).alias("code")).agg(F.max(F.col("l_quantity") * 2).alias("x"))
    top = i.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("x"), "code"))).where("r <= 3").drop("r")
    d = t.orders.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("doc"), (F.substring("o_orderpriority", 1, 1).cast("int") + 3).alias("level"), (F.col("o_orderstatus") == "P").alias("changed"))
    best = top.groupBy("doc").agg(F.max("x").alias("best"))
    m = d.join(best, "doc", "left").withColumn("m", jobs.materiality(F.col("level"), F.col("changed"), F.coalesce("best", F.lit(0.0)))).where("m.worth")
    g = m.join(top, "doc", "left")
    return g.groupBy(F.coalesce("code", F.lit(-1)).alias("code")).agg(
        F.countDistinct("doc").alias("n_docs"), F.min("level").alias("level"), F.round(F.max(F.coalesce("x", F.lit(0.0))), 4).alias("intensity"), F.min("doc").alias("first_doc")
    )


_HITS = "3 * len(list_filter(h, lambda x: x = '{0}')) + least(1, len(list_filter(k, lambda x: x = '{0}')))"


@R.query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(source || ' ' || lang || ' ' || string_split(text, ' ')[1]), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS h, regexp_extract_all(lower(substr(text, 1, 1800)), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS k FROM documents),
p AS (SELECT doc_id, {_HITS.format('the')} AS s, {_HITS.format('les')} + {_HITS.format('fr')} AS b, {_HITS.format('und')} + {_HITS.format('de')} AS p FROM w)
SELECT doc_id, CASE WHEN s >= 3 AND b = 0 AND p = 0 THEN 'co_quan_nha_nuoc' WHEN s = 0 AND (b >= 3 OR p >= 3) THEN CASE WHEN b >= p THEN 'doanh_nghiep' ELSE 'ca_nhan' END END AS audience FROM p""")
def m12_funnel(t):
    """Audience by three lexicons over title and body, undecided ones left null.

    The tables have no titles: source, language and the first word stand for one; the body is the whole text, of
    which the rule itself looks at the first 1,800 characters.
    """
    title = F.concat_ws(" ", "source", "lang", F.get(F.split("text", " "), F.lit(0)))
    s, b, p = (forms.points(title, F.col("text"), w) for w in (["the"], ["les", "fr"], ["und", "de"]))
    d = t.documents.select("doc_id", forms.audience(s, b, p, F.lit(None).cast("string"), ["x"], ["y"]).alias("a"))
    return d.select("doc_id", "a.audience")


@R.query("""
SELECT doc_id, sha256(text) <> sha256(CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE text END) AS reset, doc_id % 4 = 0 AS is_new FROM documents""")
def m13_form_save(t):
    """A changed body clears what was concluded from it."""
    d = t.documents.select("doc_id", "text")
    old = F.sha2(F.when(F.col("doc_id") % 6 == 0, "old").otherwise(F.col("text")), 256)
    cur = d.where("doc_id % 4 <> 0").select("doc_id", old.alias("body_hash"), F.lit("x").alias("audience"))
    out = forms.saved(cur, d, "doc_id", "text")
    return out.select("doc_id", (F.col("audience").isNull() & ~F.col("is_new") | (F.col("is_new") & (F.col("doc_id") % 6 == 0))).alias("reset"), "is_new")


@R.query("""
SELECT o_custkey, count_if(o_orderstatus = 'P') AS n_unknown, CASE WHEN count_if(o_orderstatus = 'P') > 0 THEN '{"unknown":[' || string_agg(CASE WHEN o_orderstatus = 'P' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) || ']}' ELSE '{}' END AS payload
FROM orders GROUP BY o_custkey""")
def m15_limitations(t):
    """Nested payload in which empty parts are left out."""
    missing = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))))
    g = t.orders.groupBy("o_custkey").agg(missing.alias("m"))
    body = F.to_json(F.struct(F.when(F.size("m") > 0, F.col("m")).alias("unknown")), {"ignoreNullFields": "true"})
    return g.select("o_custkey", F.size("m").cast("long").alias("n_unknown"), body.alias("payload"))


@R.query("""
SELECT doc_id, '{' || concat_ws(',', CASE WHEN quality = 1 THEN '"b":1' END, CASE WHEN toxic = 1 THEN '"x":1' END) || '}' AS flags FROM labels""")
def m16_flags(t):
    """Flags as a compact object without false ones."""
    flags = F.struct(F.when(F.col("quality") == 1, 1).alias("b"), F.when(F.col("toxic") == 1, 1).alias("x"))
    return t.labels.select("doc_id", F.to_json(flags, {"ignoreNullFields": "true"}).alias("flags"))


@R.query("""
WITH q(w) AS (VALUES ('the'), ('und')), d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+') AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT w AS word, count(*) AS n FROM q JOIN d ON list_contains(k, w) GROUP BY w""")
def r09_form_search(t):
    """Folded search restricted to published rows."""
    from statuta.operators.retrieval import tokens

    d = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("k"))
    return d.select(F.explode("k").alias("word")).where(F.col("word").isin("the", "und")).groupBy("word").agg(F.count("*").alias("n"))


@R.query("SELECT user_id, count(*) AS uses, max(ts) AS last_used FROM events WHERE event_type = 'view' GROUP BY user_id")
def r10_usage(t):
    """Use counts and dates from an event log."""
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))


@R.query("SELECT doc_id, array_to_string(string_split('[' || source || '] ' || lang || ' ' || text, ' ')[1:1500], ' ') AS input FROM documents")
def r11_embedding_input(t):
    """Number, heading and content, cut at a number of words, as a model connector takes it."""
    whole = F.concat(F.lit("["), "source", F.lit("] "), "lang", F.lit(" "), "text")
    return t.documents.select("doc_id", F.array_join(F.slice(F.split(whole, " "), 1, 1500), " ").alias("input"))


@R.query("""
WITH c AS (SELECT doc_id, sha256(text) AS h, 2 - doc_id % 2 AS v, 'insight ' || doc_id AS s FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id, c.s AS cached FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id AND c.h = sha256(d.text) AND c.v = 2""")
def r14_insight_cache(t):
    """A cached value that holds for one content and one version."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    c = d.where("doc_id % 3 <> 0").select("doc_id", "h", (2 - F.col("doc_id") % 2).alias("v"), F.concat(F.lit("insight "), "doc_id").alias("cached"))
    return d.join(c.where("v = 2").drop("v"), ["doc_id", "h"], "left").select("doc_id", "cached")


@R.query("""
WITH l AS (SELECT l_orderkey, string_agg('{"part":' || l_partkey || ',"supplier":' || l_suppkey || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"order":' || o_orderkey || ',"status":"' || o_orderstatus || '","items":[' || items || ']}' AS context FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def r15_context(t):
    """Nested context of a document with its parts in order."""
    item = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["part"].alias("part"), s["supplier"].alias("supplier"))).alias("items"))
    j = t.orders.where("o_orderstatus = 'P'").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), "items")).alias("context"))


def _payload(t):
    """Landed registry items made of orders, as JSON."""
    o = t.orders.join(t.lineitem.where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    ref = F.struct((F.col("l_partkey") % 7).alias("referenceType"), F.struct(F.col("l_partkey").cast("string").alias("docNum"), F.col("l_suppkey").cast("string").alias("id")).alias("targetDocument"))
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("docNum"), F.struct(F.col("o_orderstatus").alias("name")).alias("effStatus"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("A")).alias("agencyName"), F.struct(F.lit("B").alias("name")).alias("organization"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("issueDate"), F.array(ref).alias("references"),
    )
    return o.dropDuplicates(["o_orderkey"]).select(F.from_json(F.to_json(item), f"struct<{payloads._inline(payloads.ITEM)}>").alias("i")).select("i.*")


@R.query("""
SELECT o_orderkey::VARCHAR AS moj_id, o_orderpriority AS doc_num, o_orderstatus AS eff_status, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS agency_name, o_orderdate::DATE AS issue_date FROM orders""")
def e01_document_rows(t):
    """Registry items as flat rows."""
    return payloads.document_rows(_payload(t)).select("moj_id", "doc_num", "eff_status", "agency_name", "issue_date")


@R.query("""
SELECT l_partkey % 7 AS code, CASE l_partkey % 7 WHEN 1 THEN 'Bãi bỏ' WHEN 3 THEN 'Căn cứ' ELSE 'Chưa xác định (mã ' || (l_partkey % 7) || ')' END AS relation, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def e02_relation_labels(t):
    """Relation labels by code, unknown ones with their code."""
    c = (F.col("l_partkey") % 7).alias("code")
    return t.lineitem.select(c).withColumn("relation", payloads.relation_label(F.col("code"))).groupBy("code", "relation").agg(F.count("*").alias("n"))


@R.query("""
WITH q AS (SELECT doc_id, (doc_id % 5 + 1)::INT AS a, 'old' AS e FROM documents WHERE doc_id % 3 = 0), f AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), d AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0)
SELECT coalesce(q.doc_id, f.doc_id) AS doc_id, coalesce(a, 0) + (f.doc_id IS NOT NULL)::INT AS attempts, CASE WHEN f.doc_id IS NOT NULL THEN 'new' ELSE e END AS last_error
FROM (SELECT * FROM q WHERE doc_id NOT IN (SELECT doc_id FROM d)) q FULL JOIN f ON q.doc_id = f.doc_id""")
def k05_retry_queue(t):
    """K5, K6: failures count up, successes leave."""
    d = t.documents.select("doc_id")
    q = d.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") % 5 + 1).cast("int").alias("attempts"), F.lit("old").alias("last_error"))
    return sinks.queue_upsert(q, d.where("doc_id % 2 = 0").withColumn("last_error", F.lit("new")), d.where("doc_id % 9 = 0"), ["doc_id"])


@R.query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN (SELECT o_orderkey, (o_custkey % 4)::INT AS n FROM orders) ON o_orderkey = l_orderkey WHERE n IS NULL OR l_linenumber < n""")
def k10_stale_tail(t):
    """Parts past a document's new length go."""
    n = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4).cast("int").alias("n"))
    return rollups.live_parts(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), n, "l_orderkey", "l_linenumber", "n")


@R.query("""SELECT '{"item_id":' || item_id || ',"n":' || length(text) || '}' AS value FROM benchmark""")
def k11_metadata_json(t):
    """One object a row without internal columns."""
    b = t.benchmark.select("item_id", F.length("text").alias("n"), F.lit("x").alias("_hidden"), F.lit(1).alias("id"))
    return sinks.metadata_json(b)


@R.query("""
WITH p AS (SELECT doc_id, sha256(text) AS digest FROM documents), o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END) AS digest FROM documents WHERE doc_id % 2 = 0)
SELECT p.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.digest = p.digest THEN 'same' ELSE 'changed' END AS action FROM p LEFT JOIN o ON p.doc_id = o.doc_id""")
def k14_incremental_pages(t):
    """Pages to publish by digest."""
    d = t.documents.select("doc_id", "text")
    old = d.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("text")), 256).alias("digest"))
    return sinks.changed_pages(d, old, "doc_id", "text").select("doc_id", "action")


@R.query("""
WITH s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS i FROM supplier), e AS (SELECT DISTINCT a.i AS i, b.i AS j FROM lineitem JOIN s a ON a.s_suppkey = l_suppkey JOIN s b ON b.s_suppkey = l_partkey % 100 WHERE a.i <> b.i)
SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS neighbours FROM e GROUP BY i""")
def k15_adjacency(t):
    """Neighbours by position in an exported list."""
    pos = sinks.positioned(t.supplier.select("s_suppkey", "s_name"), [F.col("s_name"), F.col("s_suppkey")], "i").select("s_suppkey", "i")
    a, b = pos.withColumnRenamed("s_suppkey", "_a"), pos.select(F.col("s_suppkey").alias("_b"), F.col("i").alias("j"))
    e = t.lineitem.join(a, F.col("l_suppkey") == F.col("_a")).join(b, F.col("l_partkey") % 100 == F.col("_b")).where("i <> j").select("i", "j").distinct()
    return e.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list("j")), lambda x: x.cast("string")), ",").alias("neighbours"))


@R.query("""
SELECT doc_id, CASE WHEN length(text) = 0 THEN 'no_text' WHEN doc_id % 8 = 0 THEN 'failed' ELSE 'read' END AS status, count(*) OVER (PARTITION BY doc_id % 8 = 0) AS n_like FROM documents""")
def e20_bundle(t):
    """Rows split into read, without text and failed."""
    status = F.when(F.length("text") == 0, "no_text").when(F.col("doc_id") % 8 == 0, "failed").otherwise("read")
    d = t.documents.select("doc_id", status.alias("status"), (F.col("doc_id") % 8 == 0).alias("f"))
    n = d.groupBy("f").agg(F.count("*").alias("n_like"))
    return d.join(F.broadcast(n), "f").select("doc_id", "status", "n_like")  # two rows


@R.query("""
SELECT p_partkey, min(grp) AS grp FROM (SELECT p_partkey, 0 AS grp FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_brand LIKE '%1' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_retailprice > 1500) GROUP BY p_partkey""")
def e30_first_group_wins(t):
    """Union of groups in which the first group of a key wins."""
    parts = [t.part.where(c).select("p_partkey", F.lit(i).alias("grp")) for i, c in enumerate(("p_size < 10", "p_brand LIKE '%1'", "p_retailprice > 1500"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("p_partkey").agg(F.min("grp").alias("grp"))


@R.query("""
WITH u AS (SELECT p_size, max(p_partkey) AS k, count(*) AS n FROM part WHERE p_retailprice > 1400 GROUP BY p_size)
SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'assigned' ELSE 'ambiguous' END AS outcome, count(*) AS n_rows FROM lineitem LEFT JOIN u ON u.p_size = l_quantity::INT GROUP BY 1""")
def e44_assignment_counts(t):
    """Assigned, ambiguous and unknown numbers sum to the whole."""
    u = t.part.where("p_retailprice > 1400").groupBy("p_size").agg(F.count("*").alias("n"))
    j = t.lineitem.join(u, F.col("l_quantity").cast("int") == F.col("p_size"), "left")
    return j.groupBy(F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "assigned").otherwise("ambiguous").alias("outcome")).agg(F.count("*").alias("n_rows"))


@R.query("""
WITH k AS (SELECT lower(p_type) AS s, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1) SELECT p_partkey, lower(p_type) AS slug, n > 1 AS collides FROM part JOIN k ON k.s = lower(p_type)""")
def e11_case_fold_collisions(t):
    """Slugs that collide once lower-cased."""
    k = t.part.groupBy(F.lower("p_type").alias("slug")).agg(F.count("*").alias("n")).where("n > 1")
    p = t.part.select("p_partkey", F.lower("p_type").alias("slug"))
    return p.join(k, "slug").select("p_partkey", "slug", (F.col("n") > 1).alias("collides"))
