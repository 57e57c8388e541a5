"""Queries for rules that other queries only use in passing: each shows its own rule."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import facts, text, values
from statuta.operators import forms, graph, impact, jobs, keys, records, retrieval
from statuta.plans.tables import Registry
from statuta.session import spread
from statuta.sources import payloads, sinks
from statuta.streaming import scans

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
WITH c AS (SELECT o_custkey AS k, max(o_orderpriority) AS p, bool_or(o_orderstatus = 'P') AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), i AS (SELECT o_custkey AS k, max(o_clerk) AS c, min(o_orderpriority) AS p FROM (SELECT *, o_orderstatus AS o_clerk FROM orders) WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(c.k, i.k) AS k, coalesce(c.p, i.p) AS first_seen, i.c AS last_status, coalesce(c.s, FALSE) AS sticky, c.k IS NULL AS is_new FROM c FULL JOIN i ON c.k = i.k""")
def k01_document_upsert(t):
    """Known fields fill only what is empty, refreshed ones take the new value, flags stay true."""
    none = F.lit(None).cast("string")
    cur = t.orders.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("first_seen"), F.max(none).alias("last_status"), F.bool_or(F.col("o_orderstatus") == "P").alias("sticky"))
    new = t.orders.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("first_seen"), F.max("o_orderstatus").alias("last_status"), F.max(F.lit(None).cast("boolean")).alias("sticky"))
    out, _ = keys.upsert(cur, new, "k", refresh=["last_status"], fill=["first_seen"], sticky=["sticky"])
    return out.select("k", "first_seen", "last_status", "sticky", "is_new")


@R.query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS version, len(embedding)::INT AS dims FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 3 = 0")
def k03_vector_upsert(t):
    """K3: vectors are deleted and inserted by id; those of a wrong length don't come in."""
    e = t.embeddings.select("vec_id", F.size("embedding").alias("dims"))
    old, new = e.where("vec_id % 3 = 0").withColumn("version", F.lit("old")), e.where("vec_id % 4 = 0").withColumn("version", F.lit("new"))
    good = new.join(F.broadcast(e.agg(F.max("dims").alias("_d"))), F.col("dims") == F.col("_d")).drop("_d")  # one row
    return records.replaced_by_source(old, good, "vec_id").select("vec_id", "version", "dims")


@R.query("""
WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, coalesce(nullif(l_returnflag, 'N'), '-') AS rel, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3) SELECT src, dst, rel, q FROM e""")
def k04_edge_upsert(t):
    """K4: one edge a source, target and relation; a missing relation is a value of the key."""
    rel = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("-"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), rel.alias("rel")).agg(F.max("l_quantity").alias("q"))


@R.query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 'kept' ELSE 'inserted' END AS origin FROM part WHERE p_size < 20 OR p_partkey % 2 = 0")
def k06_insert_if_absent(t):
    """K6: rows come in where their key is not there yet."""
    old = t.part.where("p_size < 20").select("p_partkey", F.lit("kept").alias("origin"))
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.lit("inserted").alias("origin"))
    return old.unionByName(new.join(old, "p_partkey", "left_anti"))


@R.query("""
SELECT n_regionkey AS code, v AS version, CASE WHEN v = 2 THEN 'new' ELSE 'old' END AS profile FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES (1), (2)) x(v) WHERE v = 1 OR n_regionkey < 3""")
def k07_profile_upsert(t):
    """K7, K9: profiles by industry and version; the same key is replaced, other versions stay."""
    r = t.nation.select(F.col("n_regionkey").alias("code")).distinct()
    old = r.withColumn("version", F.lit(1)).unionAll(r.where("code < 2").withColumn("version", F.lit(2))).withColumn("profile", F.lit("old"))
    new = r.where("code < 3").select("code", F.lit(2).alias("version"), F.lit("new").alias("profile"))
    return keys.upsert_coalesced(old, new, [F.col("code"), F.col("version")], ["code", "version", "profile"], [])


@R.query("SELECT ts::DATE AS day, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2")
def k12_daily_snapshot(t):
    """What lands on each day from each source."""
    return t.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


@R.query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <= 20")
def p02_default_filters(t):
    """A caller's filters win over the default ones key by key; an empty list lifts a default."""
    default, caller = {"exclude_states": ["het_toan_bo", "chua"], "closure": False}, {"exclude_states": ["het_toan_bo"]}
    none, b = F.lit(None), F.col("s_acctbal")
    s = t.supplier.select("s_suppkey", F.when(b < 0, "het_toan_bo").when(b < 1000, "chua").alias("eff_state"), F.when(F.col("s_nationkey") > 20, True).alias("is_closure_node"),
                          none.cast("boolean").alias("is_vbqppl"), none.cast("int").alias("hierarchy_level"), none.cast("date").alias("issue_date"), none.cast("string").alias("field_name"))
    return s.where(retrieval.chunk_filter(**(default | caller))).select("s_suppkey")


@R.query("""
SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_type IN ('click', 'view') AND (event_id % 7 = 0 OR ts::DATE >= DATE '2024-01-10')""")
def p03_post_filters(t):
    """Membership in a JSON array (malformed: excluded) and a range of dates that a missing date passes."""
    tags = F.when(F.col("event_id") % 5 == 0, "[broken").otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]')))
    day = F.when(F.col("event_id") % 7 != 0, F.to_date("ts"))
    e = t.events.select("event_id", values.json_array(tags).alias("tags"), day.alias("day"))
    return e.where(F.arrays_overlap("tags", F.array(F.lit("click"), F.lit("view"))) & (F.col("day").isNull() | (F.col("day") >= "2024-01-10"))).select("event_id")


@R.query("SELECT doc_id FROM labels WHERE coalesce(quality, 0) = 1 OR coalesce(toxic, 0) = 1")
def p06_publishable(t):
    """Forms for business or for persons; null flags are none."""
    return t.labels.where((F.coalesce("quality", F.lit(0)) == 1) | (F.coalesce("toxic", F.lit(0)) == 1)).select("doc_id")


@R.query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'")
def p07_pending_uploads(t):
    """Rows not synced yet that are no closure nodes; an unknown flag is none."""
    low = F.when(F.col("o_orderpriority") == "5-LOW", True).when(F.col("o_orderpriority") != "4-NOT SPECIFIED", False)
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("synced"), low.alias("closure"))
    return o.where("synced IS NULL AND NOT coalesce(closure, false)").select("o_orderkey")


@R.query("""
WITH f AS (SELECT p_partkey, p_name, CASE p_size % 5 WHEN 0 THEN 'het_hieu_luc' WHEN 1 THEN 'can_kiem_tra' ELSE 'con_hieu_luc' END AS s FROM part WHERE p_brand LIKE '%1%')
SELECT p_partkey, s AS state FROM f WHERE s <> 'con_hieu_luc' ORDER BY CASE s WHEN 'het_hieu_luc' THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 25""")
def p15_warnings(t):
    """Forms with a warning, worst first, then by title, cut."""
    s = F.when(F.col("p_size") % 5 == 0, "het_hieu_luc").when(F.col("p_size") % 5 == 1, "can_kiem_tra").otherwise("con_hieu_luc")
    f = t.part.where("contains(p_brand, '1')").select("p_partkey", "p_name", s.alias("state")).where("state <> 'con_hieu_luc'")
    rank = F.array_position(F.array(*[F.lit(x) for x in jobs.FORM_STATES]), F.col("state"))
    return f.orderBy(rank, "p_name", "p_partkey").limit(25).select("p_partkey", "state")


@R.query("""
WITH u AS (SELECT p_size AS n, max(p_partkey) AS one, count(*) AS c, count(*) FILTER (WHERE p_brand LIKE '%1') AS cen, max(CASE WHEN p_brand LIKE '%1' THEN p_partkey END) AS cone FROM part GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN c = 1 THEN one WHEN cen = 1 THEN cone END AS target FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 5 = 0) LEFT JOIN u ON n = l_quantity::INT""")
def j21_reference_linking(t):
    """By number if it is the only one, else by the only central one; a label without a slash has none."""
    number = F.concat(F.col("p_size").cast("string"), F.lit("/X"))
    one = keys.unique_lookup(t.part.select(number.alias("n"), "p_partkey"), "n", "p_partkey", "one")
    central = keys.unique_lookup(t.part.where("p_brand LIKE '%1'").select(number.alias("n"), "p_partkey"), "n", "p_partkey", "central")
    label = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise("/X"))
    r = t.lineitem.where("l_orderkey % 5 = 0").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", label.alias("n")).distinct()
    j = r.join(one, "n", "left").join(central, "n", "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.contains("n", F.lit("/")), F.coalesce("one", "central")).alias("target"))


@R.query("""
SELECT count(*) AS edges, count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS collapsed_old, count(*) - count(DISTINCT (l_orderkey, l_partkey, l_returnflag)) AS collapsed_new
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def j30_edge_provenance(t):
    """Edges with both ends known, and how many fall together by the old key and by the new."""
    e = t.lineitem.join(t.part.where("p_size < 40"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    n = F.count("*")
    return e.agg(n.alias("edges"), (n - F.countDistinct("l_orderkey", "l_partkey")).alias("collapsed_old"), (n - F.countDistinct("l_orderkey", "l_partkey", "l_returnflag")).alias("collapsed_new"))


@R.query("""
SELECT l_partkey AS target, count(*) AS in_degree, min(l_returnflag) AS relation, min(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 3 END, 0))::INT + 1 AS depth FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30) GROUP BY l_partkey ORDER BY in_degree DESC, target""")
def a01_frontier_counts(t):
    """A1: open targets with count, smallest relation and least depth plus one (null counts as 0)."""
    r = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").cast("string").alias("target"), F.lit("n").alias("number"), F.col("l_returnflag").alias("relation"))
    src = t.orders.select(F.col("o_orderkey").alias("source"), F.col("o_orderkey").cast("string").alias("source_ext"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 3).alias("depth"))
    known, none = t.part.where("p_size < 30").select(F.col("p_partkey").cast("string").alias("target")), t.part.limit(0).select(F.lit("x").alias("target"), F.lit("y").alias("state"))
    f = graph.frontier(r, src, known, none)
    return f.select(F.col("target").cast("long").alias("target"), "in_degree", "relation", F.col("depth").cast("int").alias("depth")).orderBy(F.desc("in_degree"), "target")


@R.query("SELECT (SELECT count(*) FROM documents) AS n_corpus, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_pending, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)) AS most_cited")
def a03_scalars(t):
    """A3: counts of the corpus, of what is pending, and the largest in-degree."""
    a = t.documents.agg(F.count("*").alias("n_corpus"))
    b = t.documents.join(t.labels, "doc_id", "left_anti").agg(F.count("*").alias("n_pending"))
    c = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_cited"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


@R.query("""
WITH r AS (SELECT o_custkey AS doc, o_orderpriority AS code, sum(o_totalprice) AS x FROM orders GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY x DESC, code) AS z FROM r)
SELECT code, count(*) AS n FROM w WHERE z = 1 GROUP BY code""")
def a09_by_top_industry(t):
    """Documents counted under their first industry."""
    g = t.orders.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("code")).agg(F.sum("o_totalprice").alias("x"))
    top = g.groupBy("doc").agg(F.min_by("code", F.struct(-F.col("x"), "code")).alias("code"))
    return top.groupBy("code").agg(F.count("*").alias("n"))


@R.query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'het_toan_bo' WHEN s_suppkey % 3 = 0 THEN 'raw ' || s_nationkey ELSE 'chưa rõ' END AS state FROM supplier WHERE s_suppkey % 11 <> 0) GROUP BY 1")
def a14_home_counts(t):
    """Counts over the listed rows by state: the derived one, else the raw text, else a default."""
    s = t.supplier.where("s_suppkey % 11 <> 0").select(F.when(F.col("s_acctbal") < 0, "het_toan_bo").alias("derived"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("raw "), F.col("s_nationkey").cast("string"))).alias("raw"))
    return s.groupBy(F.coalesce("derived", "raw", F.lit("chưa rõ")).alias("state")).agg(F.count("*").alias("n"))


@R.query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS whole, sum(len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: x = 'the')))::BIGINT AS points FROM conversations GROUP BY conv_id")
def a15_sum_over_chunks(t):
    """Weighted terms summed over a document's chunks, and the chunks as one text in order."""
    c = t.conversations.select("conv_id", "turn", "text", text.term_count(F.lower("text"), "the", {}).alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return c.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("whole"), F.sum("n").cast("long").alias("points"))


@R.query("""
WITH c AS (SELECT right(p_brand, 1) AS suffix, p_container || ' · ' || (p_size % 3) AS kind, count(*) AS n FROM (SELECT *, p_type AS p_container FROM part) GROUP BY 1, 2)
SELECT suffix, sum(n)::BIGINT AS total, count(*) AS kinds, arg_min(kind, (-n, kind)) AS most FROM c GROUP BY suffix""")
def a28_facts_audit(t):
    """Facts by the suffix of numbers: total, kinds, the commonest."""
    kind = F.concat("p_type", F.lit(" · "), (F.col("p_size") % 3).cast("string"))
    c = t.part.groupBy(F.right("p_brand", F.lit(1)).alias("suffix"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return c.groupBy("suffix").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("most"))


@R.query("""
SELECT o_orderstatus AS grp, count(*) AS n, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_totalprice DESC, o_orderkey) FILTER (WHERE r <= 5) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1""")
def a30_digest(t):
    """A digest by group: how many, and the first five."""
    best = F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")
    r = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    few = t.orders.withColumn("r", r).where("r <= 5").groupBy("o_orderstatus").agg(F.transform(F.array_sort(F.collect_list(best)), lambda s: s["o_orderkey"].cast("string")).alias("l"))
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.join(few, "o_orderstatus").select(F.col("o_orderstatus").alias("grp"), "n", F.array_join("l", ", ").alias("listed"))


@R.query("SELECT CASE WHEN p_size % 4 = 0 THEN 'code' WHEN p_type LIKE '%steel%' THEN 'title' ELSE 'default' END AS source, count(*) AS n, count(*) FILTER (WHERE p_size % 4 = 0) AS changed FROM part GROUP BY 1")
def a31_field_sources(t):
    """Where fields come from, and how many change."""
    code = F.when(F.col("p_size") % 4 == 0, "4")
    f = facts.field_code(code, F.lit("none"), F.col("p_type"), {"4": 11}, {"x": 1}, [("steel", 27)])
    p = t.part.select(f["source"].alias("source"), (f["code"] != 27).alias("changed"))
    return p.groupBy("source").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@R.query("SELECT CASE WHEN toxic = 1 THEN 'tier1' WHEN quality = 1 THEN 'tier2' WHEN labels.doc_id IS NOT NULL THEN 'tier3' ELSE 'open' END AS tier, count(*) AS n FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id GROUP BY 1")
def a36_funnel(t):
    """How many each tier of a funnel decides."""
    j = t.documents.select("doc_id").join(t.labels.withColumn("there", F.lit(True)), "doc_id", "left")
    tier = F.when(F.col("toxic") == 1, "tier1").when(F.col("quality") == 1, "tier2").when(F.col("there"), "tier3").otherwise("open")
    return j.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@R.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderpriority DESC, o_orderkey LIMIT 1")
def t02_next_job(t):
    """The queued job that is due, by priority, then number."""
    return t.orders.where("o_orderstatus = 'P' AND o_orderdate <= timestamp'1997-01-01'").orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@R.query("""
WITH e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b, l_returnflag AS r FROM lineitem), n AS (SELECT s_suppkey AS n FROM supplier)
SELECT a AS node, b AS other, r AS relation, 'forward' AS direction FROM e JOIN n ON n = a UNION ALL SELECT b, a, 'bị ' || lower(r) || ' bởi', 'backward' FROM e JOIN n ON n = b""")
def u01_both_impacts(t):
    """Forward and reverse impacts together, nothing merged, reverse relations renamed."""
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation")).distinct()
    return graph.impacts(e, t.supplier.select(F.col("s_suppkey").alias("node")))


@R.query("SELECT l_partkey AS node, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS enders FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def g03_acting_on(t):
    """Who ends each document, sorted and distinct."""
    e = t.lineitem.select(F.col("l_partkey").alias("dst"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_returnflag").alias("relation"))
    return graph.acting_on(e, ("A",), "enders").select("node", F.array_join("enders", ",").alias("enders"))


@R.query("""
SELECT l_partkey, round(3 * max(CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'R' THEN 1.0 ELSE 0.5 END)::DOUBLE + 2 * ln(1 + count(*)) - 1.5 * (l_partkey % 3), 9) AS priority FROM lineitem GROUP BY l_partkey""")
def g07_crawl_priority(t):
    """Priority by relation, in-degree and depth."""
    name = F.when(F.col("l_returnflag") == "A", "Thay thế").when(F.col("l_returnflag") == "R", "Căn cứ").otherwise("Khác")
    g = t.lineitem.groupBy("l_partkey").agg(F.max(graph.relation_weight(name)).alias("w"), F.count("*").alias("n"))
    return g.select("l_partkey", F.round(graph.crawl_priority(F.col("w"), F.col("n"), F.col("l_partkey") % 3), 9).alias("priority"))


@R.query("SELECT p_size AS number, min(p_partkey) AS registry_id FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def g12_registry_memory(t):
    """The first id that was met for each number stays."""
    return t.part.where("p_brand IS NOT NULL").groupBy(F.col("p_size").alias("number")).agg(F.min("p_partkey").alias("registry_id"))


@R.query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '\"' || lower(split_part(p_name, ' ', 1)) || '\" AND \"' || lower(split_part(p_name, ' ', 2)) || '\"' END AS q FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def r01_query_builder(t):
    """Quoted search terms joined by AND, operator words dropped, empty for none."""
    words = F.when(F.col("p_partkey") % 3 == 0, F.lit("AND  OR (NOT)")).otherwise(F.concat(F.lit("("), F.upper("p_name"), F.lit(") AND")))
    terms = F.transform(retrieval.query_terms(words), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    p = t.part.where("split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
    return p.select("p_partkey", F.array_join(terms, " AND ").alias("q"))


@R.query("SELECT o_orderkey, round(0.5 * least(1.0, (o_custkey % 50) / 1000.0 / 0.033)::DOUBLE + 0.3 * exp(-0.023 * coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 300 END, 0)) + 0.2 * (o_custkey % 9) / 8, 9) AS score FROM orders")
def r06_final_score(t):
    """Relevance, recency and use; a missing date counts as fresh."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = retrieval.final_score((c % 50) / F.lit(1000.0), F.when(k % 4 > 0, k % 300), c % 9, F.lit(8))
    return t.orders.select("o_orderkey", F.round(s, 9).alias("score"))


@R.query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'no vector' END AS why FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)")
def r13_to_embed(t):
    """Only texts whose digest changed or that have no vector; deleted ones are skipped."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("now"))
    old = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("now")).alias("was"), (F.col("doc_id") % 5 != 0).alias("vector"), (F.col("doc_id") % 7 == 0).alias("deleted"))
    j = d.join(old, "doc_id").where("NOT deleted AND (now <> was OR NOT vector)")
    return j.select("doc_id", F.when(F.col("now") != F.col("was"), "changed").otherwise("no vector").alias("why"))


@R.query("SELECT s_suppkey, 's ' || s_suppkey || ' x::bộ a' AS k FROM supplier")
def f02_doc_key(t):
    """Keys of number and agency, collapsed and in lower case."""
    return t.supplier.select("s_suppkey", text.doc_key(F.concat(F.lit(" S  "), F.col("s_suppkey").cast("string"), F.lit("\tX ")), F.lit("Bộ  A ")).alias("k"))


@R.query("""
SELECT doc_id, 3 * len(list_filter(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+'), lambda x: x = 'en')) + least(1, len(list_filter(regexp_extract_all(lower(substr(text, 1, 1800)), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: x = 'en'))) AS points FROM documents""")
def f04_title_and_body(t):
    """three a hit in the title, one for any in the body's first 1,800 characters."""
    return t.documents.select("doc_id", forms.points(F.concat_ws(" ", "source", "lang"), F.col("text"), ["en"]).alias("points"))


@R.query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hợp đồng lao động' WHEN 1 THEN 'hợp đồng' END AS kind FROM part")
def f05_leading_kind(t):
    """the longest kind of paper that a title begins with."""
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("Mẫu: Hợp đồng lao động "), "p_name")).when(k == 1, F.concat(F.lit(" hợp ĐỒNG "), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", forms.kind_of_paper(title, ["hợp đồng", "hợp đồng lao động", "đơn"]).alias("kind"))


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '/2026/NĐ-CP' END AS number FROM orders")
def f09_title_number(t):
    """the first number of a title."""
    k = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Nghị định "), k, F.lit("/2026/NĐ-CP sửa 1/2020/NĐ-CP"))).otherwise("Nghị định mới")
    return t.orders.select("o_orderkey", F.nullif(text.title_number(title), F.lit("")).alias("number"))


@R.query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Chính phủ' WHEN 1 THEN 'Quốc hội' ELSE 'Bộ Y tế' END AS agency FROM orders")
def f15_agency(t):
    """the agency that a number's ending names wins over the reported one."""
    k = F.col("o_orderkey")
    number = F.concat(k.cast("string"), F.when(k % 3 == 0, "/2024/NĐ-CP").when(k % 3 == 1, "/2024/QH15").otherwise("/2024/TT-BYT"))
    return t.orders.select("o_orderkey", F.coalesce(facts.hierarchy(number)["agency"], F.lit("Bộ Y tế")).alias("agency"))


@R.query("SELECT conv_id, sha256(string_agg(role || chr(0) || text || chr(1), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def f31_chunks_digest(t):
    """one digest of a list of headings and contents."""
    pair = F.struct("turn", F.col("role").alias("heading"), F.col("text").alias("content"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(pair)).alias("p")).select("conv_id", text.content_hash("p").alias("digest"))


@R.query("""
WITH s AS (SELECT p_brand, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd FROM part GROUP BY 1) SELECT p_partkey, round(CASE WHEN sd > 0 THEN (p_retailprice - m) / sd ELSE 0 END, 6) AS z FROM part JOIN s USING (p_brand)""")
def f41_zscore(t):
    """standard scores within a group, 0 where nothing varies."""
    s = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("sd"))
    return t.part.join(s, "p_brand").select("p_partkey", F.round(values.zscore(F.col("p_retailprice"), F.col("m"), F.col("sd")), 6).alias("z"))


@R.query("""
WITH l AS (SELECT o_custkey % 40 AS doc, o_orderpriority AS code, count(*)::DOUBLE AS x FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1, 2), e AS (SELECT o_custkey % 40 AS doc, o_orderpriority AS code, sum(o_totalprice) AS x FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1, 2),
a AS (SELECT doc, code, x / sum(x) OVER (PARTITION BY doc) AS r FROM l), b AS (SELECT doc, code, x / sum(x) OVER (PARTITION BY doc) AS r FROM e)
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.code, b.code) AS code, round(CASE WHEN coalesce(a.doc, b.doc) IN (SELECT doc FROM a) AND coalesce(a.doc, b.doc) IN (SELECT doc FROM b) THEN 0.45 * coalesce(a.r, 0) + 0.55 * coalesce(b.r, 0) ELSE coalesce(a.r, 0) + coalesce(b.r, 0) END, 9) AS relevance
FROM a FULL JOIN b ON a.doc = b.doc AND a.code = b.code""")
def f44_fused_relevance(t):
    """two layers, each normalised to 1 a document; a layer that lacks a document leaves it to the other."""
    o = t.orders.select((F.col("o_custkey") % 40).alias("doc"), F.col("o_orderpriority").alias("code"), "o_custkey", "o_totalprice")
    lex = impact.shares(o.where("o_custkey % 3 <> 0").groupBy("doc", "code").agg(F.count("*").cast("double").alias("x")), "doc", "x", "rel")
    emb = impact.shares(o.where("o_custkey % 5 <> 0").groupBy("doc", "code").agg(F.sum("o_totalprice").alias("x")), "doc", "x", "rel")
    return impact.fused(lex, emb, "doc", "code").select("doc", "code", F.round("relevance", 9).alias("relevance"))


@R.query("SELECT p_partkey, CASE p_size % 12 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.9 WHEN 4 THEN 0.9 WHEN 5 THEN 0.8 WHEN 6 THEN 0.7 WHEN 7 THEN 0.6 WHEN 8 THEN 0.4 WHEN 9 THEN 0.4 ELSE 0.1 END::DOUBLE AS weight FROM part")
def f45_level_weight(t):
    """weight of a document's level; unknown and missing levels weigh least."""
    level = F.when(F.col("p_size") % 12 > 0, F.col("p_size") % 12)
    return t.part.select("p_partkey", facts.level_weight(level).cast("double").alias("weight"))


@R.query("SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders")
def f52_quarter(t):
    """labels of quarters."""
    return t.orders.select("o_orderkey", values.quarter_label(F.to_date("o_orderdate")).alias("quarter"))


@R.query("SELECT l_orderkey, bool_or(l_partkey % 7 = 3) AS has, list_has_any(list(l_suppkey), [1, 2]) AS touches FROM lineitem GROUP BY 1")
def f64_arrays(t):
    """F64: membership in and overlap of arrays."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 7).alias("p"), F.collect_set("l_suppkey").alias("s"))
    two = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    return g.select("l_orderkey", F.array_contains("p", 3).alias("has"), F.arrays_overlap("s", two).alias("touches"))


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'registry' ELSE 'portal ' || o_custkey END AS agency, CASE WHEN o_orderkey % 3 = 0 THEN 11 WHEN o_orderkey % 5 <> 0 THEN 20 END AS field FROM orders""")
def m04_authoritative(t):
    """M4: on enrichment the registry's agency wins; the portal's field only comes in if it is known."""
    k = F.col("o_orderkey")
    reg = t.orders.select("o_orderkey", F.when(k % 2 == 0, "registry").alias("a"), F.when(k % 5 != 0, 20).alias("f"))
    por = t.orders.select("o_orderkey", F.concat(F.lit("portal "), F.col("o_custkey").cast("string")).alias("b"), F.when(k % 3 == 0, 11).alias("g"))
    return reg.join(por, "o_orderkey").select("o_orderkey", F.coalesce("a", "b").alias("agency"), F.coalesce("g", "f").alias("field"))


@R.query("""
WITH c AS (SELECT l_partkey AS f, CASE WHEN bool_or(l_returnflag = 'A') THEN 'het_hieu_luc' ELSE 'con_hieu_luc' END AS s FROM lineitem GROUP BY 1)
SELECT f AS form, s AS state, CASE WHEN s = (CASE WHEN f % 3 = 0 THEN 'con_hieu_luc' ELSE 'het_hieu_luc' END) THEN 'h' || f END AS published_hash FROM c""")
def m11_recompute_forms(t):
    """The state of every form anew; where it changes the page must be published again."""
    none = F.array().cast("array<string>")
    state = jobs.reference_state(F.when(F.col("l_returnflag") == "A", "het_toan_bo").otherwise("con_hieu_luc"), none, none)
    now = jobs.worst_wins(t.lineitem.select(F.col("l_partkey").alias("form"), "l_linenumber", state.alias("s")), "form", "s", "l_linenumber")
    before = F.when(F.col("form") % 3 == 0, "con_hieu_luc").otherwise("het_hieu_luc")
    return now.select("form", "state", F.when(F.col("state") == before, F.concat(F.lit("h"), F.col("form").cast("string"))).alias("published_hash"))


@R.query("""
WITH m AS (SELECT event_type, min(ts) AS hw FROM events GROUP BY 1), s AS (SELECT event_type, max(ts) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT m.event_type, coalesce(n, hw) AS high_water FROM m LEFT JOIN s USING (event_type)""")
def x03_advance_on_success(t):
    """Marks move only for sources whose scan succeeded."""
    marks = t.events.groupBy("event_type").agg(F.min("ts").alias("high_water"))
    return scans.advanced(marks, t.events.where("event_type <> 'error'"), "event_type", "ts")


@R.query("SELECT user_id, count(*) AS n_seen, max(ts) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def x04_dedupe_in_scan(t):
    """A key that a scan meets several times counts once, by its latest row."""
    since = F.lit("2024-01-05").cast("timestamp")
    n = t.events.where(F.col("ts") >= since).groupBy("user_id").agg(F.count("*").alias("n_seen"))
    return scans.new_rows(t.events, "user_id", "ts", since).select("user_id", F.col("ts").alias("latest")).join(n, "user_id").select("user_id", "n_seen", "latest")


@R.query("""
SELECT p_partkey, CASE WHEN min(c) FILTER (WHERE c < 10) IS NOT NULL THEN min(c) FILTER (WHERE c < 10) ELSE min(c) END AS code FROM (SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 21 END AS c FROM part UNION ALL SELECT p_partkey, CASE WHEN p_type LIKE '%steel%' THEN 7 END FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_brand LIKE '%1%' THEN 3 END FROM part UNION ALL SELECT p_partkey, 30 FROM part) GROUP BY 1""")
def e03_primary_code(t):
    """Codes by keywords; the least of the business system, else the least of the other, never across both."""
    codes = F.array_compact(F.array(F.when(F.contains("p_name", F.lit("red")), 21), F.when(F.contains("p_type", F.lit("steel")), 7), F.when(F.contains("p_brand", F.lit("1")), 3), F.lit(30)))
    business = F.array_min(F.filter(codes, lambda c: c < 10))
    return t.part.select("p_partkey", F.coalesce(business, F.array_min(codes)).alias("code"))


@R.query("SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_group FROM lineitem JOIN part ON p_size = l_quantity::INT GROUP BY 1")
def e05_whole_group(t):
    """E5: a number of several rows returns its whole group: rows and members of the groups that an order names. Groups are
    counted before they meet the lines."""
    groups = t.part.groupBy("p_size").agg(F.count("*").alias("c"))
    named = t.lineitem.groupBy("l_orderkey", F.col("l_quantity").cast("int").alias("q")).agg(F.count("*").alias("n"))
    j = named.join(groups, F.col("q") == F.col("p_size"))
    return j.groupBy("l_orderkey").agg(F.sum(F.col("n") * F.col("c")).alias("n_rows"), F.sum("c").alias("n_group"))


@R.query("SELECT s_suppkey AS node, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey = s_suppkey OR l_orderkey = s_suppkey)) AS n_edges FROM supplier")
def e13_incident_edges(t):
    """Edges at either end of a number."""
    e = spread(t.lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")), 1_000_000, "a", "b").distinct()
    ends = e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("n"))
    g = ends.groupBy("n").agg(F.count("*").alias("n_edges"))
    return t.supplier.join(g, F.col("n") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("node"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@R.query("""
WITH c AS (SELECT o_custkey, count_if(o_orderstatus = 'P') AS state, count_if(o_orderpriority = '1-URGENT') AS industry, count(DISTINCT year(o_orderdate)) AS month, count_if(o_totalprice > 400000) AS level FROM orders GROUP BY 1),
f AS (SELECT o_custkey, pos, name, n FROM (SELECT o_custkey, unnest([1, 2, 3, 4]) AS pos, unnest(['state', 'industry', 'month', 'level']) AS name, unnest([state, industry, month, level]) AS n FROM c) WHERE n > 0)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY pos)::INT AS number, name, n FROM f""")
def e16_figures(t):
    """The figures of each customer's report, empty ones dropped, numbered without gaps."""
    counts = {
        "state": F.count_if(F.col("o_orderstatus") == "P"), "industry": F.count_if(F.col("o_orderpriority") == "1-URGENT"), "month": F.countDistinct(F.year("o_orderdate")),
        "level": F.count_if(F.col("o_totalprice") > 400000),
    }
    c = t.orders.groupBy("o_custkey").agg(*[n.alias(k) for k, n in counts.items()])
    some = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("n")) for k in counts]), lambda f: f["n"] > 0)
    return c.select("o_custkey", F.posexplode(some).alias("i", "f")).select("o_custkey", (F.col("i") + 1).alias("number"), "f.name", "f.n")


@R.query("""
WITH s AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7' || doc_id::VARCHAR), doc_id) AS r FROM documents) SELECT lang, doc_id FROM s WHERE r <= 10""")
def e47_stratified_sample(t):
    """Ten of each stratum by a seeded digest; reruns agree."""
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("7"), F.col("doc_id").cast("string")), 256), "doc_id")
    return t.documents.select("lang", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")


@R.query("SELECT o_orderkey::VARCHAR AS id, o_orderdate::DATE AS issued FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def s12_back_paging(t):
    """Items of the registry not older than a cutoff."""
    items = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("issueDate"))
    return payloads.incremental(items, F.lit("1997-06-01").cast("date")).select("id", values.any_date(F.col("issueDate")).alias("issued"))


@R.query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'b' END AS source FROM documents")
def s09_text_fallbacks(t):
    """A text by its stored path, else by the next key that has one."""
    d = t.documents.select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("alt"))
    a = d.where("doc_id % 4 = 0").select(F.col("path").alias("name"), F.lit("a").alias("text"))
    b = d.where("doc_id % 3 = 0").select(F.col("alt").alias("name"), F.lit("b").alias("text"))
    return payloads.text_with_fallbacks(d, a.unionAll(b), ["path", "alt"]).select("doc_id", F.col("text").alias("source"))


@R.query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0")
def k13_orphans(t):
    """Published pages that are valid no more."""
    p = t.supplier.select("s_suppkey")
    return sinks.orphans(p, p.where("s_suppkey % 3 = 0"), "s_suppkey").select("s_suppkey")
