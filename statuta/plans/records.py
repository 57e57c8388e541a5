"""Queries of parsed pages, gates, job outcomes, run logs, context and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import text
from statuta.operators import keys, records, rollups
from statuta.operators.running import running_sum
from statuta.plans.tables import Registry
from statuta.session import spread

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS kept FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 25 GROUP BY 1""")
def p05_order_preserving(t):
    """P5: of each list the keys of a set, in the list's order."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(lines, lambda s: s["l_partkey"]).alias("parts"))
    kept = records.kept_in_order(lists, "l_orderkey", "parts", t.part.where("p_size < 25").select(F.col("p_partkey").alias("part")), "part")
    return kept.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("kept"))


@R.query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' ORDER BY o_orderdate DESC")
def p08_unnotified(t):
    """Rows with an event that nobody was told of, newest first."""
    o = t.orders.withColumn("notified_at", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))).withColumn("event", F.nullif("o_orderstatus", F.lit("P")))
    return o.where("notified_at IS NULL AND event IS NOT NULL").orderBy(F.desc("o_orderdate")).select("o_orderkey", "o_orderdate")


@R.query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice > 950 AND p_type <> 'ECONOMY' AND p_brand NOT IN ('Brand#1', 'Brand#2')")
def p12_index_listing(t):
    """Rows of an index: normative, with a slug, no closure node (null counts as none), no junk number."""
    s = t.part.select(
        "p_partkey", (F.col("p_size") > 10).alias("is_vbqppl"), F.when(F.col("p_retailprice") > 950, F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"),
        F.when(F.col("p_type") == "ECONOMY", True).when(F.col("p_type") == "SMALL", False).alias("closure"),
        F.when(F.col("p_brand") == "Brand#1", " Không số ").when(F.col("p_brand") == "Brand#2", "-").otherwise(F.col("p_brand")).alias("number"),
    )
    junk = F.trim(F.coalesce("number", F.lit(""))).isin("Không số", "Khong so", "", "-")
    return s.where(F.col("is_vbqppl") & F.col("slug").isNotNull() & ~F.coalesce("closure", F.lit(False)) & ~junk).select("p_partkey")


@R.query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '/2024/NĐ-CP' WHEN 1 THEN 'Bộ luật ' || o_orderpriority ELSE o_orderkey || '/QĐ' END AS label FROM orders")
def f23_without_kind(t):
    """labels without the kind of document, where a number is left."""
    k = F.col("o_orderkey").cast("string")
    x = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Nghị  định số "), k, F.lit("/2024/NĐ-CP"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Bộ luật "), "o_orderpriority"))
    kinds = ["Nghị định", "Luật", "Bộ luật", "Quyết định"]
    return t.orders.select("o_orderkey", records.without_kind(x.otherwise(F.concat(F.lit("QUYẾT ĐỊNH "), k, F.lit("/QĐ"))), kinds).alias("label"))


@R.query("""
SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'quốc hiệu' WHEN p_partkey % 8 = 1 THEN 'phụ lục' WHEN p_partkey % 8 = 2 THEN 'đơn vị:' WHEN length(p_name) < 20 THEN 'too short' WHEN length(p_name) > 36 THEN 'too long'
WHEN p_size > 45 THEN 'no body' WHEN p_size > 40 THEN 'body too long' WHEN p_partkey % 8 = 3 THEN 'citations' END AS fault FROM part""")
def f28_gates(t):
    """Why an article is refused: its title, description, body or citations."""
    k = F.col("p_partkey") % 8
    title = F.when(k == 0, "CỘNG HOÀ … VIỆT NAM. x").when(k == 1, "Mẫu và Phụ lục chi tiết").when(k == 2, "Hợp đồng Đơn vị : Công ty").otherwise(F.col("p_name"))
    body = F.when(F.col("p_size") > 45, "  ").otherwise(F.repeat(F.lit("x"), F.col("p_size")))
    return t.part.select("p_partkey", records.article_fault(title, F.lit("d"), body, F.when(k != 3, True), (20, 36, 100, 40)).alias("fault"))


#: Words that stand for verbs of relations: the tables have none.
VERBS = ["the", "und", "que", "les", "an", "of"]


@R.query(f"""
WITH d AS (SELECT doc_id, strpos(text, '. ') AS pos, text FROM documents), b AS (SELECT doc_id, pos, CASE WHEN pos > 1 THEN lower(substr(text, greatest(1, pos - 140), least(140, pos - 1))) ELSE '' END AS b FROM d),
v AS (SELECT unnest({VERBS}) AS v), p AS (SELECT doc_id, v, length(b) - strpos(reverse(b), reverse(v)) - length(v) AS p FROM b, v WHERE pos > 0 AND contains(b, v))
SELECT doc_id, x.v AS verb FROM d LEFT JOIN (SELECT doc_id, arg_max(v, (p, v)) AS v FROM p GROUP BY doc_id) x USING (doc_id)""")
def f33_nearest_verb(t):
    """The verb that stands last in the 140 characters before a place, here the end of the first sentence."""
    return t.documents.select("doc_id", text.nearest_before("text", F.lit(". "), VERBS).alias("verb"))


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'Chua_Phan_Loai/Chua_Phan_Loai' ELSE strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate + INTERVAL 80 DAY END, '%Y/Thang_%m') END AS folder FROM orders""")
def f53_month_folder(t):
    """year and month of issue, else publication, else creation."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    days = F.when(k == 0, d), F.when(k <= 1, F.date_add(d, 40)), F.when(k <= 2, F.date_add(d, 80))
    return t.orders.select("o_orderkey", records.month_folder(*days).alias("folder"))


@R.query("""
WITH l AS (SELECT user_id AS run, ts AS w, CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, event_id, event_type FROM events),
z AS (SELECT run, min(w) AS started_at, max(CASE WHEN status <> 'RUNNING' THEN w END) AS finished_at, arg_max(l.status, (w, event_id)) AS status, max(CASE WHEN event_type = 'purchase' THEN {'w': w, 'e': event_id} END) AS m FROM l GROUP BY run)
SELECT run, started_at, finished_at, status, m.e % 100 AS found, NULL::BIGINT AS skipped FROM z""")
def e07_run_log(t):
    """Runs from an append-only log: open or closed, with the metrics of known names."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "RUNNING").when(kind == "error", "FAILED").otherwise("SUCCESS")
    metrics = F.when(kind == "purchase", F.create_map(F.lit("found"), F.col("event_id") % 100, F.lit("odd"), F.lit(1).cast("long")))
    log = t.events.select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("at"), status.alias("status"), metrics.alias("metrics"))
    r = records.latest_runs(log, "run", "at", ["found", "skipped"])
    return r.select("run", F.col("started_at.ts").alias("started_at"), F.col("finished_at.ts").alias("finished_at"), "status", "found", "skipped")


@R.query("""
SELECT n_nationkey, n_name, NULL::VARCHAR AS slug, NULL::BIGINT AS level FROM nation WHERE n_nationkey < 8 UNION ALL SELECT n_nationkey, n_name, lower(n_name), NULL FROM nation WHERE n_nationkey BETWEEN 8 AND 15
UNION ALL SELECT n_nationkey, n_name, lower(n_name), n_regionkey FROM nation WHERE n_nationkey > 15""")
def e09_schema_evolution(t):
    """Snapshots that gained columns as one table."""
    n = t.nation.select("n_nationkey", "n_name")
    later = t.nation.where("n_nationkey >= 8").select("n_nationkey", "n_name", F.lower("n_name").alias("slug"), F.col("n_regionkey").cast("long").alias("level"))
    return records.evolved(n.where("n_nationkey < 8"), later.where("n_nationkey <= 15").drop("level"), later.where("n_nationkey > 15"))


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 1 DAY END, TIMESTAMP '2026-01-01') END AS synced_at FROM orders""")
def e10_data_migration(t):
    """Where nothing was synced but a folder is known, the last change counts, else the day of the migration."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    o = t.orders.select("o_orderkey", F.when(k % 3 == 0, d).alias("synced"), F.when(k % 2 == 0, "token").alias("token"), F.when(k % 5 != 0, d + F.expr("INTERVAL 1 DAY")).alias("updated"))
    due = F.col("synced").isNull() & F.col("token").isNotNull()
    return o.select("o_orderkey", F.when(due, F.coalesce("updated", F.lit("2026-01-01").cast("timestamp"))).otherwise(F.col("synced")).alias("synced_at"))


@R.query("""
WITH n AS (SELECT DISTINCT upper(p_brand) AS number FROM part WHERE p_brand IS NOT NULL) SELECT l_orderkey, count(*) AS n_known FROM (SELECT l_orderkey, 'BRAND#' || (l_partkey % 60) AS number FROM lineitem) JOIN n USING (number) GROUP BY 1""")
def e12_known_numbers(t):
    """The set of known numbers, met by rows that cite."""
    known = t.part.where("p_brand IS NOT NULL").select(F.upper("p_brand").alias("number")).distinct()
    cited = t.lineitem.select("l_orderkey", F.concat(F.lit("BRAND#"), (F.col("l_partkey") % 60).cast("string")).alias("number"))
    return cited.join(known, "number").groupBy("l_orderkey").agg(F.count("*").alias("n_known"))


@R.query("""
WITH a AS (SELECT l_orderkey AS k, l_partkey % 50 AS x FROM lineitem WHERE l_linenumber <= 2 UNION SELECT l_orderkey, l_suppkey % 50 FROM lineitem WHERE l_linenumber > 2)
SELECT k AS l_orderkey, string_agg(x::VARCHAR, ',' ORDER BY x) AS allowed FROM a GROUP BY k""")
def e17_allowed_list(t):
    """Sorted distinct numbers of two lists of a payload."""
    own, hit = F.when(F.col("l_linenumber") <= 2, F.col("l_partkey") % 50), F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 50)
    g = rollups.sorted_union(t.lineitem, "l_orderkey", own, hit)
    return g.select("l_orderkey", F.array_join(F.transform("allowed", lambda x: x.cast("string")), ",").alias("allowed"))


@R.query("SELECT conv_id, turn, substr(text, 1, 1500) AS excerpt FROM conversations WHERE conv_id % 10 = 3 AND turn < 4")
def e18_clauses(t):
    """The first clauses of stated documents, each an excerpt."""
    c = t.conversations.where("conv_id % 10 = 3 AND turn < 4")
    return c.select("conv_id", "turn", F.substring("text", 1, 1500).alias("excerpt"))


@R.query("""
SELECT c_custkey, CASE WHEN n IS NULL THEN 'Không tìm thấy văn bản liên quan.' ELSE 'n=' || n END AS report FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def e21_report_or_refusal(t):
    """A fixed text where there is no context, so that no model is asked."""
    n = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("n").isNull(), "Không tìm thấy văn bản liên quan.").otherwise(F.concat(F.lit("n="), F.col("n").cast("string"))).alias("report"))


@R.query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS pos, p_name AS title FROM part")
def e23_form_index(t):
    """An index by task group, sorted by title: entries with their places, however many a group has."""
    index = running_sum(t.part.select("p_brand", "p_name", "p_partkey"), "p_brand", ["p_name", "p_partkey"], F.lit(1), "pos")
    return index.select("p_brand", "pos", F.col("p_name").alias("title"))


@R.query("""
WITH c AS (SELECT DISTINCT l_orderkey, l_partkey % 300 AS number FROM lineitem), u AS (SELECT p_partkey % 300 AS number, max(p_name) AS link FROM part GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey, c.number, link FROM c LEFT JOIN u ON u.number = c.number""")
def e25_appendix(t):
    """Sorted distinct numbers with their public link, if it is the only one."""
    links = keys.unique_lookup(t.part.select((F.col("p_partkey") % 300).alias("number"), "p_name"), "number", "p_name", "link")
    return t.lineitem.select("l_orderkey", (F.col("l_partkey") % 300).alias("number")).distinct().join(links, "number", "left").select("l_orderkey", "number", "link")


@R.query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 27 THEN lpad(p_size::VARCHAR, 2, '0') || '. Lĩnh vực ' || p_size ELSE '27. Lĩnh vực 27' END AS folder FROM part")
def e28_folder_label(t):
    """Numbered folders, unknown codes in the last."""
    return t.part.select("p_partkey", records.numbered_folder(F.col("p_size"), {i: f"Lĩnh vực {i}" for i in range(1, 28)}, 27).alias("folder"))


@R.query("""
SELECT o_orderkey, l_partkey::VARCHAR AS id, 'Luật ' || l_linenumber AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linenumber % 2 = 1""")
def e31_field_references(t):
    """References of a page's field: links to documents only, the id from the address."""
    n = F.col("l_linenumber").cast("string")
    kind = F.when(F.col("l_linenumber") % 2 == 1, "van-ban").otherwise("tin-tuc")
    link = F.concat(F.lit('<a class="x" href="https://x.example/'), kind, F.lit("/Thue/luat-"), n, F.lit("-"), F.col("l_partkey").cast("string"), F.lit('.aspx">Luật '), n, F.lit(" </a>, "))
    field = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(link), "").alias("html"))
    o = t.orders.where("o_orderstatus = 'P'").select("o_orderkey").join(field, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.explode(records.field_references(F.col("html"))).alias("r")).select("o_orderkey", "r.id", "r.label")


@R.query("SELECT page_id, status FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 4 = 0 THEN 'EMPTY_BODY' ELSE 'OK' END AS status FROM pages) WHERE status IS DISTINCT FROM 'OK' ORDER BY page_id")
def e32_resume_queue(t):
    """Forms that are not there yet, by key; landed pages are not fetched again."""
    status = F.when(F.col("page_id") % 6 == 0, F.lit(None)).when(F.col("page_id") % 4 == 0, "EMPTY_BODY").otherwise("OK")
    p = t.pages.select("page_id", status.alias("status"))
    return p.join(p.where("status = 'OK'").select("page_id"), "page_id", "left_anti").orderBy("page_id")


@R.query("SELECT DISTINCT l_shipdate::DATE || '/' || (l_suppkey % 40) AS number FROM lineitem WHERE l_partkey % 9 <> 0 AND l_suppkey % 40 > 3 ORDER BY 1 LIMIT 100")
def e33_missing_numbers(t):
    """Numbers of references that are still open, the first hundred."""
    key = F.when(F.col("l_partkey") % 9 == 0, F.col("l_partkey"))
    number = F.when(F.col("l_suppkey") % 40 > 3, F.concat(F.to_date("l_shipdate").cast("string"), F.lit("/"), (F.col("l_suppkey") % 40).cast("string"))).otherwise(F.lit("no number"))
    r = t.lineitem.select(key.alias("doc_key"), number.alias("number"))
    return r.where("doc_key IS NULL AND contains(number, '/')").select("number").distinct().orderBy("number").limit(100)


@R.query("""
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '1,3' ELSE array_to_string(list_sort(list_distinct([p_size, (p_partkey % 9)::INT, round(p_retailprice)::INT])), ',') END AS codes FROM part""")
def e34_whitelists(t):
    """Codes of a setting, the default where it holds anything but numbers."""
    numbers = F.concat("p_size", F.lit(" ; "), (F.col("p_partkey") % 9).cast("string"), F.lit(","), F.round("p_retailprice").cast("int").cast("string"), F.lit(";;"), "p_size")
    codes = records.whitelist(F.when(F.col("p_size") % 10 == 0, F.concat("p_size", F.lit(","), "p_type")).otherwise(numbers), [3, 1])
    return t.part.select("p_partkey", F.array_join(F.transform(codes, lambda x: x.cast("string")), ",").alias("codes"))


@R.query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'khac' END AS label, least(1.0, greatest(0.0, user_id / 40.0 - 1))::DOUBLE AS confidence FROM events")
def e35_label_clamp(t):
    """Labels of a closed set, confidence held in 0 to 1."""
    label = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("khac")
    return t.events.select("event_id", label.alias("label"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("user_id") / 40 - 1)).alias("confidence"))


@R.query("""
WITH c AS (SELECT DISTINCT o_orderkey, n FROM (SELECT o_orderkey, unnest([o_custkey % 90, o_orderkey % 70, 7]) AS n FROM orders)), k AS (SELECT DISTINCT p_size AS n FROM part)
SELECT o_orderkey, count(*) AS total, count(*) FILTER (WHERE k.n IS NULL) AS missing FROM c LEFT JOIN k USING (n) GROUP BY 1""")
def e36_citation_check(t):
    """Numbers cited in title, description and body, found or missing in a store."""
    say = lambda c: F.concat(F.lit("theo "), c.cast("string"), F.lit("/2020/NĐ-CP"))
    whole = F.concat_ws("\n", say(F.col("o_custkey") % 90), say(F.col("o_orderkey") % 70), F.lit("và 7/2020/NĐ-CP."))
    numbers = F.array_distinct(F.regexp_extract_all(whole, F.lit(r"\b(\d+)/2020/NĐ-CP"), F.lit(1)))
    cited = t.orders.select("o_orderkey", F.explode(F.transform(numbers, lambda x: x.cast("int"))).alias("n"))
    known = t.part.select(F.col("p_size").alias("n"), F.lit(1).alias("k")).distinct()
    return cited.join(known, "n", "left").groupBy("o_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"))


@R.query("SELECT doc_id, CASE WHEN lang = 'en' THEN sha256(nullif(regexp_replace(text || chr(10) || '# not a head', '^\\s+|\\s+$', '', 'g'), '')) END AS body FROM documents")
def e37_section(t):
    """A section of markdown, from its head to the next."""
    page = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit(" \n"), "text", F.lit("\n# not a head\n\n## Next\nx"))
    return t.documents.select("doc_id", F.sha2(records.section(page, "en"), 256).alias("body"))


@R.query("""
WITH x AS (SELECT o_orderkey, 'a' || o_orderkey || '/X ' || repeat('b', 30) || ' 9/Y' AS body, 'c' || (o_custkey % 8) || '/Z' || repeat(' d', 20) || ' 5/W' AS ref FROM orders),
y AS (SELECT o_orderkey, CASE WHEN length(body) > 40 THEN rtrim(substr(body, 1, 39)) || '…' ELSE body END || chr(10) || chr(10) || rtrim(substr(ref, 1, 29)) || '…' AS t FROM x)
SELECT o_orderkey, t AS text, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+/[A-Z]'))), ',') AS allowed FROM y""")
def e38_context(t):
    """Texts are cut before their numbers are allowed."""
    body = F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("/X "), F.repeat(F.lit("b"), F.lit(30)), F.lit(" 9/Y"))
    ref = F.concat(F.lit("c"), (F.col("o_custkey") % 8).cast("string"), F.lit("/Z"), F.repeat(F.lit(" d"), F.lit(20)), F.lit(" 5/W"))
    c = t.orders.select("o_orderkey", records.context(body, F.array(ref), 40, 30, "[0-9]+/[A-Z]").alias("c"))
    return c.select("o_orderkey", "c.text", F.array_join("c.allowed", ",").alias("allowed"))


@R.query("""
SELECT r_regionkey, pos, sentence FROM (SELECT r_regionkey, unnest(s) AS sentence, generate_subscripts(s, 1)::INT - 1 AS pos FROM (SELECT r_regionkey, list_concat([r_name, lower(r_name)], list('Quy định pháp luật về ' || n_name || '.' ORDER BY n_name)) AS s FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name))""")
def e40_profile_sentences(t):
    """Names and a sentence a keyword for each industry."""
    words = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("words"))
    r = t.region.join(words, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("short", F.lower("r_name"))
    return records.profile_sentences(r, "r_regionkey", ["r_name", "short"], "words")


@R.query("""
WITH o AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 4 = 0)
SELECT src, dst FROM o WHERE src NOT IN (SELECT src FROM n) UNION ALL SELECT src, dst FROM n""")
def e45_graph_rebuild(t):
    """The edges of rebuilt documents replace their old ones."""
    old = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    new = t.lineitem.where("l_orderkey % 4 = 0").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return records.replaced_by_source(old, new, "src")


@R.query("""
WITH c AS (SELECT n_nationkey AS code, count(c_custkey) AS n, count(c_custkey) FILTER (WHERE c_acctbal > 9000) AS cited FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT code, CASE WHEN n > 0 THEN n ELSE (SELECT count(*) FROM customer) END AS n_documents, cited AS n_cited, CASE WHEN n > 0 THEN 'industry' ELSE 'whole store' END AS scope FROM c""")
def e46_industry_statistics(t):
    """Counts over a whole industry, not only over what a report cites, with the scope where there is none."""
    codes = t.nation.select(F.col("n_nationkey").alias("code"))
    return rollups.scoped_counts(codes, t.customer.withColumn("code", F.col("c_nationkey")), "code", F.col("c_acctbal") > 9000)


@R.query("SELECT o_custkey AS child, max(o_orderkey) AS parent FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) = 1")
def e48_parents(t):
    """A cache from parents to children turned round; a child of several parents has none."""
    cache = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("child"))
    return keys.unique_lookup(cache, "child", "parent")


def _jobs(t):
    """Report jobs made of orders: kinds a, b, c; outputs with cited numbers."""
    k = F.col("o_orderkey")
    jobs = t.orders.select(k.alias("job"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int")).alias("kind"), F.when(k % 3 == 2, k - 1).alias("parent"))
    cited = t.lineitem.groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 100).cast("string")).alias("cited"), F.collect_list(F.when(F.col("l_linenumber") == 1, (F.col("l_partkey") % 100).cast("string"))).alias("allowed"))
    out = cited.where("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_orderkey") % 13 == 0, "boom").alias("error"), "cited", "allowed")
    known = t.part.where("p_partkey < 96").select(F.col("p_partkey").cast("string").alias("number")).distinct()
    return records.outcomes(jobs, out, known)


_JOBS = """
j AS (SELECT o_orderkey AS job, (['a', 'b', 'c'])[o_orderkey % 3 + 1] AS kind, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey - 1 END AS parent FROM orders),
o AS (SELECT DISTINCT l_orderkey AS job, CASE WHEN l_orderkey % 13 = 0 THEN 'boom' END AS error FROM lineitem WHERE l_orderkey % 11 <> 0),
c AS (SELECT DISTINCT l_orderkey AS job, l_partkey % 100 AS n FROM lineitem),
a AS (SELECT DISTINCT l_orderkey AS job, l_partkey % 100 AS n FROM lineitem WHERE l_linenumber = 1),
m AS (SELECT job, count(*) AS total, count(*) FILTER (WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_partkey < 96) AND (job, n) NOT IN (SELECT (job, n) FROM a)) AS missing FROM c GROUP BY job),
e AS (SELECT j.job, kind, CASE WHEN kind = 'c' AND parent NOT IN (SELECT job FROM o WHERE error IS NULL) THEN 'parent has no output' WHEN o.job IS NULL THEN 'no output' ELSE o.error END AS error FROM j LEFT JOIN o USING (job)),
s AS (SELECT e.job, kind, CASE WHEN error IS NOT NULL THEN 'FAILED' WHEN missing > 0 THEN 'BLOCKED_CITATION' ELSE 'DONE' END AS status, CASE WHEN error IS NULL THEN total END AS citation_total, CASE WHEN error IS NULL THEN missing END AS citation_missing, error FROM e LEFT JOIN m USING (job))"""


@R.query(f"WITH {_JOBS} SELECT * FROM s")
def m09_job_outcomes(t):
    """M9: states of report jobs: failed, blocked by the citation gate, done."""
    return _jobs(t)


@R.query(f"""WITH {_JOBS}, i AS (SELECT l_orderkey AS job, 'N' || (l_suppkey % 5) AS code, max(l_quantity * 2)::DOUBLE AS x FROM lineitem GROUP BY 1, 2)
SELECT code || '-' || s.job AS key, code, s.job AS parent, 'bao_cao_b_' || s.job || '_cuong_do_' || x::BIGINT AS reason, x AS priority FROM s JOIN i USING (job) WHERE kind = 'b' AND status = 'DONE' AND x >= 60 AND s.job % 7 <> 0""")
def m09_chained_jobs(t):
    """M9: a job for each industry that a finished report affects enough, unless it is queued already."""
    affected = t.lineitem.groupBy(F.col("l_orderkey").alias("job"), F.concat(F.lit("N"), (F.col("l_suppkey") % 5).cast("string")).alias("code")).agg(F.max(F.col("l_quantity") * 2).cast("double").alias("intensity")).where("intensity >= 60")
    queued = affected.where("job % 7 = 0").select(F.concat("code", F.lit("-"), F.col("job").cast("string")).alias("key"))
    return records.chained(_jobs(t), affected, queued)


@R.query("""
SELECT p_partkey // 20 AS page, CASE p_partkey % 3 WHEN 0 THEN 'hopdong-' ELSE 'bieumau-' END || p_partkey AS form_key, 'mau-' || p_partkey AS slug, p_name AS title, 1234 AS total, (p_partkey // 20) % 7 > 0 AS has_next,
'https://x/' || CASE p_partkey % 3 WHEN 0 THEN 'hopdong' ELSE 'bieumau' END || '/' || p_partkey || '/mau-' || p_partkey || '?tab=1' AS url, p_brand || ';' || replace(p_type, 'POLISHED ', 'POLISHED & ') AS keywords,
CASE WHEN p_partkey % 5 > 0 THEN DATE '2024-01-01' + (p_size::INT) END AS updated_on FROM part""")
def s06_form_listing(t):
    """Listing pages of at most twenty rows as items with keywords, dates, the stated total and whether a page follows.
    Rows are nested and striped, attributes stand in any order, texts are cut into tags, each item stands there twice."""
    lit, k = F.lit, F.col("p_partkey")
    key = k.cast("string")
    path = F.concat(F.when(k % 3 == 0, "/hopdong/").otherwise("/bieumau/"), key, lit("/mau-"), key, lit("?tab=1"))
    mid = F.ceil(F.length("p_name") / 2).cast("int")
    name = F.concat(lit("<b><span>"), F.substring("p_name", lit(1), mid), lit("</span><span>"), F.substring("p_name", mid + 1, lit(99)), lit("</span></b>"))
    link = F.when(k % 2 == 0, F.concat(lit("<a title='a > b' class=t href=\""), path, lit('">'))).otherwise(F.concat(lit("<a href='"), path, lit("' title=\"x\">")))
    words = F.concat(lit("<p class='x links-bot'>Từ khoá: <a href=/tu>"), "p_brand", lit("</a>, <a href=/tu><i> "), F.replace("p_type", lit("POLISHED "), lit("POLISHED &amp; ")), lit("\n</i></a><a> </a></p>"))
    day = F.when(k % 5 > 0, F.date_format(F.date_add(lit("2024-01-01").cast("date"), F.col("p_size")), "'Cập nhật: 'd/M/yyyy")).otherwise("Cập nhật: 31/02/2024")
    right = F.concat(lit("<div><div class='right-col small'><em>"), day, lit("</em></div></div>"))
    item = F.concat(lit("<div class='row content-"), (k % 2).cast("string"), lit("'><div><p class='nqTitle big'>\n"), link, lit("\n"), name, lit("\n</a></p><div>x</div></div>"), words, right, lit("</div>"))
    parts = spread(t.part.withColumn("page", F.floor(k / 20)), 5_000, "page")
    page = parts.groupBy("page").agg(F.array_join(F.collect_list(F.concat(item, item)), "").alias("items"))  # twenty a page
    head = lit("<title>x</title><script>var a = '<div class=content-1>';</script><p>Tìm thấy <b>1.234</b> biểu mẫu</p><p class='nqTitle'><a href='/tin/1/x'>x</a></p>")
    more = F.when(F.col("page") % 7 > 0, "<div class=pages><a href='?p=2'><b>Trang</b> <span>sau</span> »</a>").otherwise("<!-- <a>Trang sau</a> --><a>Trang trước</a>")
    got = records.listing(page.select("page", F.concat(head, "items", more).alias("html")), "page", "html", base="https://x")
    return got.select("page", "form_key", "slug", "title", "total", "has_next", "url", F.array_join("keywords", ";").alias("keywords"), "updated_on")


@R.query("""
WITH b AS (SELECT *, 'Căn cứ số ' || p_partkey % 10000 || '/2024/NĐ-CP, điện thoại 028/3930/3279.' || ' ' || repeat(p_name || ' ', p_size) AS body FROM part),
d AS (SELECT *, length(trim(body)) >= 200 AS fine FROM b)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'T ' || p_brand END AS title, CASE WHEN p_partkey % 3 > 0 THEN DATE '2024-02-05' END AS updated_on,
CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 = 0 THEN '131/2025/TT-BTC|Thông tư 131/2025/TT-BTC|https://x/van-ban/a-77.aspx|77|field;Luật Thuế|Luật Thuế|http://y/van-ban/b||field'
  ELSE (p_partkey % 10000) || '/2024/NĐ-CP|' || (p_partkey % 10000) || '/2024/NĐ-CP|||body' END AS refs,
CASE WHEN fine THEN 'OK' ELSE 'EMPTY_BODY' END AS status, CASE WHEN fine THEN sha256(trim(body)) END AS body FROM d""")
def s07_form_detail(t):
    """Form pages of both kinds as title, body, day, references and a status for bodies that are too short. Blocks
    are nested, words cut into tags, attributes stand in any order."""
    lit, k = F.lit, F.col("p_partkey")
    cut = lambda c: F.concat(F.substring(c, lit(1), lit(7)), lit("</span><span>"), F.substring(c, lit(8), lit(99)))
    path = F.when(k % 2 == 0, F.concat(lit("<p>Trang chủ =&gt; <i>Biểu mẫu</i> =&gt; <span> "), "p_name", lit(" </span></p>"))).otherwise("<p>Biểu mẫu</p>")
    links = "<a class=q href='/van-ban/a-77.aspx'>Thông tư <b>131/2025/TT-BTC</b></a> <a href='/tin/2'>y</a> <a href=\"http://y/van-ban/b\">Luật Thuế</a>"
    meta = F.when(k % 3 > 0, F.concat(lit("<p><span style='x'><b>Cập nhật:</b> 5/02/2024 "), F.when(k % 5 == 0, f"Căn cứ: {links}").otherwise(""), lit("</span></p>"))).otherwise(f"<p><b>{links}</b></p>")
    start = F.concat(lit("<div><p><span>Căn cứ </span><span>số "), (k % 10000).cast("string"), lit("/2024/NĐ</span><span>-CP, điện thoại 028/3930/3279.</span></p></div>"))
    body = F.concat(start, F.repeat(F.concat(lit("<div><span>"), cut(F.col("p_name")), lit("</span></div>")), F.col("p_size")))
    share = lit("<div class='share'>In / Zing Me</div>")
    own = F.concat(lit("<div id=b class=\"a divNoiDungBM\" style=x>"), body, lit("</div>"), share)
    frame = F.concat(lit("<div class='divTNPL'>"), share, lit("<div>"), body, lit("</div>"), lit("<div>"), F.repeat(lit("quảng cáo "), lit(30)), lit("</div></div>"))
    short = F.concat(lit("<div class='divTNPL'>"), body, lit("</div>"))  # too short for a block of its own: the whole frame
    large = F.length(F.concat(lit("Căn cứ số "), (k % 10000).cast("string"), lit("/2024/NĐ-CP, điện thoại 028/3930/3279."), F.repeat("p_name", F.col("p_size")))) >= 200  # without breaks
    html = F.concat(lit("<html><title>T "), "p_brand", lit("</title><body>"), path, meta, F.when(k % 4 < 2, own).otherwise(F.when(large, frame).otherwise(short)))
    d = records.detail(spread(t.part, 5_000, "p_partkey").select("p_partkey", html.alias("html")), "p_partkey", "html", base="https://x")
    refs = F.transform("refs", lambda r: F.concat_ws("|", r["doc_num"], r["label"], F.coalesce(r["url"], lit("")), F.coalesce(r["document_id"], lit("")), r["source"]))
    return d.select("p_partkey", "title", "updated_on", F.array_join(refs, ";").alias("refs"), "status", F.sha2("body", 256).alias("body"))


@R.query("""
WITH v AS (SELECT doc_id % 2 AS version, doc_id FROM documents), n AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT 0 AS version, doc_id FROM n UNION ALL SELECT version, doc_id FROM v WHERE version <> 0""")
def k08_replace_version(t):
    """K8: rows of one version are deleted, then inserted; other versions stay."""
    old = t.documents.select((F.col("doc_id") % 2).alias("version"), "doc_id")
    new = t.documents.where("doc_id % 3 = 0").select(F.lit(0).cast("long").alias("version"), "doc_id")
    return records.replaced_by_source(old, new, "version").select(F.col("version").cast("int").alias("version"), "doc_id")


@R.query("""
SELECT '[' || string_agg('{"id":' || item_id || ',"n":' || length(text) || '}', ',' ORDER BY item_id) || ']' AS payload FROM benchmark WHERE item_id < 50""")
def k21_handoff(t):
    """A bounded hand-off as one JSON array."""
    item = F.struct(F.col("item_id").alias("id"), F.length("text").alias("n"))
    few = t.benchmark.where("item_id < 50").agg(F.array_sort(F.collect_list(item)).alias("a"))  # at most fifty
    return few.select(F.to_json("a").alias("payload"))


@R.query("""
SELECT o_orderkey, CASE WHEN r = 1 THEN 'written' ELSE 'locked' END AS outcome FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""")
def x06_single_writer(t):
    """Of the runs that ask for a lock the first has it."""
    first = t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("_holder"))
    j = t.orders.select("o_orderkey", "o_custkey").join(first, "o_custkey")
    return j.select("o_orderkey", F.when(F.col("o_orderkey") == F.col("_holder"), "written").otherwise("locked").alias("outcome"))
