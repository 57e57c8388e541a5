"""Full-text and vector retrieval, rank fusion and re-scoring, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions.text import strip_marks
from statuta.functions.values import distance
from statuta.session import written

K1, B = 1.2, 0.75
#: Distinct search terms, and query vectors, up to which they are sent to every task.
MOST_TERMS, FEW = 1000, 10_000
#: Fixed values of the final score: shares of relevance, recency, use; decay a day; scale of a full fusion score.
SHARES, DECAY, FULL, RRF = (0.5, 0.3, 0.2), 0.023, 0.033, 60


def tokens(text: Column) -> Column:
    """Lower-case words without marks."""
    return F.regexp_extract_all(strip_marks(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct search terms; the operator words AND, OR, NOT, NEAR in capitals are none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin("AND", "OR", "NOT", "NEAR"))
    return F.array_distinct(F.transform(kept, lambda w: strip_marks(F.lower(w))))


def search_mode(text: Column) -> Column:
    """KEYWORD for one word or code-like text, else HYBRID."""
    code = F.trim(text).rlike(r"[{}();=<>\[\]]|[/\\]|\.\w{2,4}$")
    return F.when(code | (F.size(F.split(F.trim(text), r"\s+")) <= 1), "KEYWORD").otherwise("HYBRID")


def found_terms(docs: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """A written table (key, len, found): length of each text in words and, of those, the terms of any query."""
    terms = [r["term"] for r in queries.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} distinct search terms at a time")
    words = tokens(F.col(text))
    kept = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("len"), F.filter(w, lambda x: x.isin(*terms)).alias("found")))
    return written(docs.select(key, F.get(kept, F.lit(0)).alias("t")).select(key, "t.*"), "found-terms")


def postings(found: DataFrame, key: str) -> DataFrame:
    """(term, key, tf, len): the inverted index of found terms."""
    t = found.select(key, "len", F.explode("found").alias("term"))
    return t.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def chunk_filter(
    exclude_states: list[str] | None = None, closure: bool = False, normative_only: bool = True, max_level: int | None = None,
    field: str | None = None, first: str | None = None, last: str | None = None,
) -> Column:
    """Conditions on chunks in which a null never excludes."""
    c = F.lit(True)
    for state in exclude_states or []:
        c = c & (F.col("eff_state").isNull() | (F.col("eff_state") != state))
    if not closure:
        c = c & ~F.coalesce("is_closure_node", F.lit(False))
    if normative_only:
        c = c & F.coalesce("is_vbqppl", F.lit(True))
    if max_level is not None:
        c = c & (F.col("hierarchy_level").isNull() | (F.col("hierarchy_level") <= max_level))
    if field is not None:
        c = c & (F.col("field_name") == field)
    if first is not None:
        c = c & (F.col("issue_date").isNull() | (F.col("issue_date") >= first))
    return c & (F.col("issue_date").isNull() | (F.col("issue_date") <= last)) if last is not None else c


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, all_terms: bool = True) -> DataFrame:
    """(query, key, score) of every match; queries has (query, terms).

    Texts are read once; only searched terms leave them. Postings stay where they are: what meets them is
    one row a searched term, at most MOST_TERMS of them a query.
    """
    found = found_terms(docs, key, text, queries)
    hit = postings(found, key)
    q = queries.select("query", F.size("terms").alias("_want"), F.explode("terms").alias("term"))
    df = found.select(F.explode(F.array_distinct("found")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    whole = found.agg(F.count("*").alias("_docs"), F.avg("len").alias("_mean"))  # one row
    idf = F.greatest(F.log((F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("_mean")))
    j = hit.join(F.broadcast(q.join(df, "term").join(F.broadcast(whole))), "term")
    g = j.groupBy("query", key, "_want").agg(F.sum(part).alias("score"), F.count("*").alias("_have"))
    return (g.where("_have = _want") if all_terms else g).drop("_want", "_have")


def met(rows: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """Every row with every one of a stated set (a table of queries or centroids with a key).

    Up to FEW of the set are broadcast; more meet the rows in blocks of that many, by a number.
    """
    blocks = -(-stated.count() // FEW)
    if blocks <= 1:
        return rows.join(F.broadcast(stated))
    each = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(stated.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "_block").drop("_block")


def nearest(vectors: DataFrame, key: str, v: str, queries: DataFrame) -> DataFrame:
    """(query, key, distance) over all vectors, filtered beforehand; queries has (query, v)."""
    both = met(vectors, queries.select("query", F.col("v").alias("_q")), "query")
    return both.select("query", key, distance(F.col(v), F.col("_q")).alias("distance"))


def ranked(hits: DataFrame, by: list[Column], limit: int, name: str = "rank") -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query").orderBy(*by))
    return hits.withColumn(name, r).where(F.col(name) <= limit)


def fuse(a: DataFrame, b: DataFrame, key: str, k: int = RRF) -> DataFrame:
    """(query, key, rank_a, rank_b, rrf) of two ranked lists; a list that lacks a key adds nothing."""
    j = a.select("query", key, F.col("rank").alias("rank_a")).join(b.select("query", key, F.col("rank").alias("rank_b")), ["query", key], "full")
    one = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return j.withColumn("rrf", one("rank_a") + one("rank_b"))


def final_score(rrf: Column, days: Column, uses: Column, most_uses: Column) -> Column:
    """Relevance up to a full fusion score, recency and use; a missing date counts as fresh."""
    a, b, c = SHARES
    use = uses / F.when(F.coalesce(most_uses, F.lit(0)) == 0, 1).otherwise(most_uses)
    return a * F.least(F.lit(1.0), rrf / FULL) + b * F.exp(-DECAY * F.coalesce(days, F.lit(0))) + c * use


def best_of(hits: DataFrame, key: str, score: str) -> DataFrame:
    """One row a key over several queries: that of the highest score, then the smallest query."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "query"))
    return hits.withColumn("_r", r).where("_r = 1").drop("_r")
