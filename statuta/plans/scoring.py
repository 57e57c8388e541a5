"""Impact scoring, retrieval and graph queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta import lifecycles
from statuta.functions import values
from statuta.operators import cells, crawl, graph, impact, index, retrieval
from statuta.operators.kept import generations
from statuta.plans.tables import Registry
from statuta.session import shared_folder

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("""
SELECT label, i - 1 AS at, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i""")
def a17_centroid(t):
    """Mean vector of each label, component by component."""
    return impact.centroids(t.embeddings, "label", "embedding", 6).select("label", F.col("at").cast("long").alias("at"), "value")


def _similar(t):
    """Cosine of every vector with every label's centroid: ten labels."""
    c = impact.as_vectors(impact.centroids(t.embeddings, "label", "embedding"), "label").withColumnRenamed("label", "code")
    return retrieval.met(t.embeddings, c, "code").select("vec_id", "label", "code", values.cosine(F.col("embedding"), F.col("centroid")).alias("cos"))


_COS = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT label AS code, list(a ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, label, code, list_cosine_similarity(v, c) AS cos FROM e, m)
"""


@R.query("WITH " + _COS + "SELECT code, round(avg(cos), 6) AS mean, round(stddev_pop(cos), 6) AS sd FROM s GROUP BY code")
def a18_calibration(t):
    """Mean and population deviation of the cosine per code."""
    return _similar(t).groupBy("code").agg(F.round(F.avg("cos"), 6).alias("mean"), F.round(F.stddev_pop("cos"), 6).alias("sd"))


@R.query("WITH " + _COS + """, z AS (SELECT vec_id // 5 AS doc, code, vec_id, (cos - avg(cos) OVER (PARTITION BY code)) / stddev_pop(cos) OVER (PARTITION BY code) AS z FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, code ORDER BY z DESC, vec_id) AS r FROM z)
SELECT doc, code, round(avg(z), 5) AS score FROM r WHERE r <= 3 GROUP BY doc, code""")
def a19_topk_mean(t):
    """Mean of the best z-scores per document and code."""
    s = _similar(t)
    stats = s.groupBy("code").agg(F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sd"))
    z = s.join(stats, "code").withColumn("z", values.zscore(F.col("cos"), F.col("mean"), F.col("sd")))
    b = impact.best_mean(z.withColumn("doc", F.floor(F.col("vec_id") / 5)), ["doc", "code"], "z", ["vec_id"], 3)
    return b.select("doc", "code", F.round("score", 5).alias("score"))


@R.query("""
SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS cos,
round(list_distance(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""")
def f40_cosine(t):
    """cosine and distance of pairs."""
    b = t.embeddings.select(F.col("vec_id").alias("k"), F.col("embedding").alias("e2"))
    j = t.embeddings.withColumn("k", F.floor(F.col("vec_id") / 2)).join(b, "k")
    return j.select("vec_id", F.round(values.cosine(F.col("embedding"), F.col("e2")), 6).alias("cos"), F.round(values.distance(F.col("embedding"), F.col("e2")), 6).alias("dist"))


@R.query("WITH " + _COS + "SELECT vec_id, code, round(exp(cos - max(cos) OVER w) / sum(exp(cos)) OVER w * exp(max(cos) OVER w), 6) AS p FROM s WINDOW w AS (PARTITION BY vec_id)")
def f42_softmax(t):
    """softmax per vector."""
    m = _similar(t).withColumn("top", F.max("cos").over(Window.partitionBy("vec_id")))
    e = m.withColumn("e", F.exp(F.col("cos") - F.col("top")))
    return e.select("vec_id", "code", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("vec_id")), 6).alias("p"))


@R.query("""
WITH d AS (SELECT doc_id, n_chars % 97 + 1 AS restrictions, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 12 END AS level FROM documents),
l AS (SELECT doc_id, code, rel / sum(rel) OVER (PARTITION BY doc_id) AS rel FROM (SELECT doc_id, code, ((doc_id * 7 + code * 3) % 5)::DOUBLE AS rel FROM documents, range(4) c(code) WHERE doc_id % 3 <> 0) QUALIFY sum(rel) OVER (PARTITION BY doc_id) > 0),
e AS (SELECT doc_id, code, rel / sum(rel) OVER (PARTITION BY doc_id) AS rel FROM (SELECT doc_id, code, ((doc_id * 5 + code * 11) % 7)::DOUBLE AS rel FROM documents, range(4) c(code) WHERE doc_id % 4 <> 0) QUALIFY sum(rel) OVER (PARTITION BY doc_id) > 0),
j AS (SELECT coalesce(l.doc_id, e.doc_id) AS doc_id, coalesce(l.code, e.code) AS code, l.rel AS rl, e.rel AS re FROM l FULL JOIN e ON l.doc_id = e.doc_id AND l.code = e.code),
f AS (SELECT doc_id, code, CASE WHEN bool_or(rl IS NOT NULL) OVER w AND bool_or(re IS NOT NULL) OVER w THEN 0.45::DOUBLE * coalesce(rl, 0) + 0.55::DOUBLE * coalesce(re, 0)
  WHEN bool_or(rl IS NOT NULL) OVER w THEN coalesce(rl, 0) ELSE coalesce(re, 0) END AS rel FROM j WINDOW w AS (PARTITION BY doc_id)),
i AS (SELECT f.doc_id, code, restrictions * rel * CASE WHEN level IN (1, 2) THEN 1.0::DOUBLE WHEN level IN (3, 4) THEN 0.9 WHEN level = 5 THEN 0.8 WHEN level = 6 THEN 0.7 WHEN level = 7 THEN 0.6 WHEN level IN (8, 9) THEN 0.4 ELSE 0.1 END AS raw FROM f JOIN d ON f.doc_id = d.doc_id)
SELECT doc_id, code::INT AS code, round(raw, 6) AS impact_raw, round(CASE WHEN sum(raw) OVER (PARTITION BY doc_id) > 0 THEN 100 * raw / sum(raw) OVER (PARTITION BY doc_id) ELSE 0 END, 6) AS impact_pct_doc FROM i""")
def c06_impact_score(t):
    """Two layers fused, raw impact, shares per document."""
    codes = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("code")
    d = t.documents.select("doc_id", codes)
    layer = lambda drop, a, b, m: impact.shares(d.where(F.col("doc_id") % drop != 0).withColumn("s", ((F.col("doc_id") * a + F.col("code") * b) % m).cast("double")), "doc_id", "s", "rel")
    f = impact.fused(layer(3, 7, 3, 5), layer(4, 5, 11, 7), "doc_id", "code")
    facts = t.documents.select("doc_id", (F.col("n_chars") % 97 + 1).alias("restrictions"), F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 12).alias("level"))
    i = impact.impact(f.join(facts, "doc_id"), "doc_id")
    return i.select("doc_id", "code", F.round("impact_raw", 6).alias("impact_raw"), F.round("impact_pct_doc", 6).alias("impact_pct_doc"))


#: Stated searches.
SEARCHES = [(1, "the of and"), (2, "les des que"), (3, "und der"), (4, "mit license")]


def _searches(t):
    s = t.documents.sparkSession.createDataFrame(SEARCHES, "query int, words string")
    return s.select("query", "words", retrieval.query_terms(F.col("words")).alias("terms"))


_BM25 = """
p AS (SELECT doc_id, len(k) AS len, unnest(k) AS term FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+') AS k FROM documents)),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT avg(len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+'))) FROM documents) AS mean FROM documents),
q(query, words) AS (VALUES (1, 'the of and'), (2, 'les des que'), (3, 'und der'), (4, 'mit license')),
qt AS (SELECT query, unnest(string_split(words, ' ')) AS term, len(string_split(words, ' ')) AS want FROM q),
i AS (SELECT term, doc_id, any_value(len) AS len, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM i GROUP BY term),
s AS (SELECT query, doc_id, sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.mean))) AS score FROM qt JOIN i USING (term) JOIN df USING (term), n
  GROUP BY query, doc_id, want HAVING count(*) = want),
r AS (SELECT query, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, doc_id)::INT AS rank FROM s)
"""


def _kept(t, name, build):
    """Where a table's index is: it is made once an application and read by every search after that."""
    spark = t.documents.sparkSession
    path = f"{shared_folder(spark)}/{name}-{hashlib.sha256(t._folder.encode()).hexdigest()[:16]}"
    return path if generations(spark, path) else build(path)


def _text_hits(t, limit=100):
    path = _kept(t, "index", lambda p: index.build(t.documents, "doc_id", F.col("text"), p))
    return index.search(t.documents.sparkSession, path, _searches(t), limit, digits=5).withColumnRenamed("key", "doc_id")


@R.query("WITH " + _BM25 + "SELECT query, doc_id, score, rank FROM r WHERE rank <= 100")
def r02_bm25(t):
    """Full-text top 100 of several searches, from a kept index."""
    return _text_hits(t).select("query", "doc_id", "score", "rank")


def _asked(t):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("int").alias("query"), F.col("embedding").alias("v"))


_KNN = """
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
k AS (SELECT q.vec_id::INT AS query, v.vec_id, round(list_distance(q.v, v.v), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, v.v), 6), v.vec_id)::INT AS rank FROM v, v q WHERE q.vec_id % 50 = 0)
"""


def _near(t, limit=50):
    path = _kept(t, "cells", lambda p: cells.build(t.embeddings, "vec_id", "embedding", p))
    return cells.search(t.embeddings.sparkSession, path, _asked(t), limit, digits=6).withColumnRenamed("key", "vec_id")


@R.query("WITH " + _KNN + "SELECT query, vec_id, distance, rank FROM k WHERE rank <= 50")
def r03_knn(t):
    """Nearest vectors of stated queries, from kept cells."""
    return _near(t).select("query", "vec_id", "distance", "rank")


_FUSE = """
a AS (SELECT m.vec_id::INT AS query, doc_id, rank AS ra FROM r JOIN embeddings m ON r.query = (m.vec_id // 50) % 4 + 1 WHERE m.vec_id % 50 = 0 AND rank <= 60),
b AS (SELECT query, vec_id AS doc_id, rank AS rb FROM k WHERE rank <= 60),
f AS (SELECT query, doc_id, ra, rb, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS rrf FROM a FULL JOIN b USING (query, doc_id))
"""


def _fused(t):
    asked = _asked(t).select("query", (F.floor(F.col("query") / 50) % 4 + 1).cast("int").alias("_s"))
    a = _text_hits(t, 60).withColumnRenamed("query", "_s").join(asked, "_s")  # each vector goes with one of the four searches
    b = _near(t, 60).select("query", F.col("vec_id").alias("doc_id"), "rank")
    return retrieval.fuse(a, b, "doc_id")


@R.query("WITH " + _BM25 + "," + _KNN + "," + _FUSE + "SELECT query, doc_id, ra AS rank_a, rb AS rank_b, round(rrf, 8) AS rrf FROM f")
def r05_rrf(t):
    """Rank fusion of a text and a vector list."""
    return _fused(t).withColumn("rrf", F.round("rrf", 8))


@R.query("WITH " + _BM25 + "," + _KNN + "," + _FUSE + """,
g AS (SELECT f.*, round(0.5::DOUBLE * least(1.0, rrf / 0.033) + 0.3::DOUBLE * exp(-0.023 * (doc_id % 400)) + 0.2::DOUBLE * (doc_id % 9) / 8, 6) AS final FROM f JOIN documents USING (doc_id) WHERE source <> 'src0'),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, ra NULLS LAST, doc_id) AS pos FROM g)
SELECT query, doc_id, final, pos::INT AS pos FROM h WHERE pos <= 20""")
def r07_hybrid(t):
    """Fused, filtered, re-scored, cut."""
    f = _fused(t).join(t.documents.where("source <> 'src0'").select("doc_id"), "doc_id")
    s = retrieval.final_score(F.col("rrf"), F.col("doc_id") % 400, F.col("doc_id") % 9, F.lit(8))
    g = f.withColumn("final", F.round(s, 6))
    return retrieval.ranked(g, [F.desc("final"), F.col("rank_a").asc_nulls_last(), F.col("doc_id")], 20, "pos").select("query", "doc_id", "final", "pos")


@R.query("WITH " + _BM25 + "," + _KNN + """,
c AS (SELECT doc_id, DATE '2024-01-01' - (doc_id % 300)::INT AS day, doc_id % 9 AS uses FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 3),
a AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY r.rank) AS ra FROM r JOIN c USING (doc_id) QUALIFY ra <= 100),
b AS (SELECT query // 50 AS query, vec_id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY k.rank) AS rb FROM k JOIN c ON c.doc_id = vec_id WHERE query IN (50, 100, 150, 200) QUALIFY rb <= 100),
f AS (SELECT query, doc_id, ra, rb, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS rrf FROM a FULL JOIN b USING (query, doc_id)),
g AS (SELECT f.*, round(0.5::DOUBLE * least(1.0, rrf / 0.033) + 0.3::DOUBLE * exp(-0.023 * (DATE '2024-02-01' - day)) + 0.2::DOUBLE * uses / 8, 5) AS final FROM f JOIN c USING (doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, ra NULLS LAST, doc_id) AS pos FROM g)
SELECT query::INT AS query, doc_id, final, pos::INT AS pos FROM h WHERE pos <= 10""")
def r07_search_entry(t):
    """The search job: default filters before both lists, vectors from an embedder, recency and use."""
    k, none = F.col("doc_id"), F.lit(None)
    chunks = t.documents.select(
        k.alias("key"), k.cast("string").alias("doc"), none.cast("string").alias("status"), F.when(k % 7 == 0, "het_toan_bo").alias("eff_state"), F.when(k % 11 == 3, True).alias("is_closure_node"),
        none.cast("boolean").alias("is_vbqppl"), none.cast("int").alias("hierarchy_level"), F.col("source").alias("field_name"), F.date_sub(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).alias("issue_date"), (k % 9).alias("uses"),
    )
    vectors = t.embeddings.where("vec_id IN (50, 100, 150, 200)").select((F.col("vec_id") / 50).cast("int").alias("query"), F.col("embedding").alias("v"))
    texts, near = _kept(t, "index", lambda p: index.build(t.documents, "doc_id", F.col("text"), p)), _kept(t, "cells", lambda p: cells.build(t.embeddings, "vec_id", "embedding", p))
    queries = _searches(t).select("query", F.col("words").alias("text"))
    found = lifecycles.hybrid_search(t.documents.sparkSession, texts, chunks, queries, near, lambda asked: asked.join(vectors, "query"), as_of=F.lit("2024-02-01").cast("date"), digits=5)
    return found.select("query", F.col("key").alias("doc_id"), "final", "pos")


@R.query("WITH " + _BM25 + "SELECT doc_id, score, query FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, query) AS z FROM r WHERE rank <= 35) WHERE z = 1")
def r08_multi_query(t):
    """Best score of each row over several searches."""
    return retrieval.best_of(_text_hits(t, 35), "doc_id", "score").select("doc_id", "score", "query")


@R.query("""
SELECT doc_id, CASE WHEN regexp_matches(trim(w), '[{}();=<>\\[\\]]|[/\\\\]|\\.\\w{2,4}$') OR len(string_split_regex(trim(w), '\\s+')) <= 1 THEN 'KEYWORD' ELSE 'HYBRID' END AS mode
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 4) WHEN 1 THEN substr(text, 1, 30) ELSE 'a/b c' END AS w FROM documents)""")
def r04_search_mode(t):
    """Keyword or hybrid search. The tables have no queries: the first 4 or 30 characters of texts stand for some."""
    w = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 4)).when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 30)).otherwise("a/b c")
    return t.documents.select("doc_id", retrieval.search_mode(w).alias("mode"))


def _edges(t):
    """Customer to supplier through the lines of orders."""
    o = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_linestatus").alias("relation")).distinct()


_EDGES = "e AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_linestatus AS relation FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@R.query("WITH RECURSIVE " + _EDGES + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h(node, depth) AS (SELECT 'c10', 0 UNION SELECT b, depth + 1 FROM h JOIN u ON a = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM h GROUP BY node""")
def g01_bfs(t):
    """Fewest hops from a node, three at most."""
    return graph.hops(_edges(t), t.customer.where("c_custkey = 10").select(F.concat(F.lit("c"), "c_custkey").alias("node")), 3)


@R.query("WITH RECURSIVE " + _EDGES + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h(node, depth) AS (SELECT 'c10', 0 UNION SELECT b, depth + 1 FROM h JOIN u ON a = node WHERE depth < 1), n AS (SELECT DISTINCT node FROM h)
SELECT DISTINCT src, dst, relation FROM e WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n)""")
def g06_cascade(t):
    """Edges within two hops of a node."""
    return graph.cascade(_edges(t), t.customer.where("c_custkey = 10").select(F.concat(F.lit("c"), "c_custkey").alias("node")), 2)


@R.query("WITH RECURSIVE " + _EDGES + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h(node, depth) AS (SELECT 'c' || c_custkey, 0 FROM customer WHERE c_acctbal > 9500 UNION SELECT b, depth + 1 FROM h JOIN u ON a = node WHERE depth < 5)
SELECT node, min(depth) AS depth FROM h GROUP BY node""")
def g09_depth(t):
    """Multi-source depth with a cap."""
    return graph.hops(_edges(t), t.customer.where("c_acctbal > 9500").select(F.concat(F.lit("c"), "c_custkey").alias("node")), 5)


@R.query("WITH " + _EDGES + """, x AS (SELECT DISTINCT dst FROM e WHERE relation = 'O' AND src = 'c10'), m AS (SELECT dst, string_agg(DISTINCT src, ', ' ORDER BY src) AS w FROM e WHERE relation = 'F' GROUP BY dst)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 AND m.w IS NOT NULL THEN 'partly out of force | amended by: ' || m.w WHEN s_suppkey % 4 = 1 THEN 'partly out of force' WHEN m.w IS NOT NULL THEN 'amended by: ' || m.w ELSE '' END AS warnings
FROM supplier LEFT JOIN m ON m.dst = 's' || s_suppkey WHERE s_suppkey % 4 <> 0 AND 's' || s_suppkey NOT IN (SELECT dst FROM x)""")
def g04_validity(t):
    """Rows neither expired nor ended, with warnings."""
    e = _edges(t).where("relation <> 'O' OR src = 'c10'")
    s = F.when(F.col("s_suppkey") % 4 == 0, "Hết hiệu lực").when(F.col("s_suppkey") % 4 == 1, "Hết hiệu lực một phần").otherwise("Còn hiệu lực")
    chunks = t.supplier.select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("doc"), s.alias("status"))
    return graph.valid_only(chunks, e, ending=("O",), amending=("F",)).select("s_suppkey", "warnings")


@R.query("WITH " + _EDGES + "SELECT dst AS node, count(*) AS in_degree FROM e GROUP BY dst HAVING count(*) > 5")
def g10_hubs(t):
    """Nodes cited more than a bound."""
    return graph.in_degrees(_edges(t)).where("in_degree > 5")


@R.query("WITH RECURSIVE " + _EDGES + """, hubs AS (SELECT dst AS node FROM e GROUP BY dst HAVING count(*) > 560), k AS (SELECT DISTINCT src, dst FROM e WHERE src NOT IN (SELECT node FROM hubs)),
h(node, depth) AS (SELECT 'c' || c_custkey, 0 FROM customer WHERE c_acctbal > 9800 UNION SELECT dst, depth + 1 FROM h JOIN k ON src = node WHERE depth < 3), r AS (SELECT node, min(depth) AS depth FROM h GROUP BY node)
SELECT node, depth, CASE WHEN depth > 2 THEN 'TOO_DEEP' WHEN node IN (SELECT node FROM hubs) THEN 'HUB_NOT_EXPANDED' WHEN node IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) THEN 'DONE' ELSE 'NO_ID' END AS state FROM r""")
def g08_closure(t):
    """A crawl by rounds over landed documents, with hubs and a depth cap."""
    seeds = t.customer.where("c_acctbal > 9800").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    store = t.supplier.where("s_suppkey % 5 <> 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.closure(_edges(t), store, seeds, cap=2, hub=560)


@R.query()
def g08_closure_rounds(t):
    """The closure loop in two runs of half a budget: priorities, rounds, failures, hubs, what is pending.

    Parts cite parts through the lines of orders; a part of size 7 isn't there, one of size 9 can't be read. SQL has no
    loop over such state; tests hold it against one document at a time.
    """
    spark, n = t.part.sparkSession, t.part.count()
    cited = F.col("l_partkey").cast("string")
    relation = F.when(F.col("l_returnflag") == "A", "Căn cứ").when(F.col("l_returnflag") == "R", "Thay thế").otherwise("khác")
    refs = t.lineitem.select((F.col("l_orderkey") % n + 1).cast("string").alias("source"), cited.alias("target"), F.concat(cited, F.lit("/2024")).alias("number"), relation.alias("relation"))
    key = F.col("p_partkey").cast("string")
    store = t.part.where("p_size <> 7").select(key.alias("node"), F.concat(key, F.lit("/2024")).alias("number"), F.when(F.col("p_size") == 9, "broken").alias("error"))
    seeds = t.part.where("p_retailprice > 1900").select(key.alias("node"), F.lit(None).cast("int").alias("depth"))
    path = crawl.start(f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}", seeds, refs)
    for _ in range(2):
        crawl.run(spark, path, refs, store, budget=max(1, n // 4), batch=min(crawl.MOST_BATCH, max(1, n // 5)), nodes=n, hub=2 * t.lineitem.count() // n)
    return crawl.state(spark, path)[0].select("target", "state", "depth", "in_degree", F.round("priority", 6).alias("priority"), "attempts", "error")
