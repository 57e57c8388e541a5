"""The three jobs that users start: searching, the impact batch and the daily ingest. Each is a plan over the library's
operators; models and fetching are callables or landed tables that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import phrases
from statuta.functions.facts import hierarchy
from statuta.functions.values import cosine, days_since, zscore
from statuta.operators import cells, graph, impact, index, retrieval
from statuta.operators.kept import generations
from statuta.session import written
from statuta.sources import paged, payloads, sinks
from statuta.sources.upserts import Table

#: Hits of each list, states that no search shows unless it is asked to.
LIST, HIDDEN = 100, ("het_toan_bo",)
DEFAULTS = {"exclude_states": list(HIDDEN), "closure": False, "normative_only": False}


def hybrid_search(
    spark: SparkSession, text_index: str, chunks: DataFrame, queries: DataFrame, cells_path: str | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None,
    filters: dict | None = None, limit: int = 10, as_of: Column | None = None, digits: int | None = None, edges: DataFrame | None = None,
) -> DataFrame:
    """(query, key, final, pos, rank_a, rank_b, rrf and the chunk's columns) of the best chunks of each query.

    chunks: key, doc, status, eff_state, is_closure_node, is_vbqppl, hierarchy_level, field_name, issue_date, uses; queries: (query, text).
    Filters (see retrieval.chunk_filter) go over the defaults and count before both lists are cut. Only queries that aren't
    a single word or code ask for vectors, by `embedder`: (query, text) to (query, v). With edges (src, dst, relation), chunks of
    documents that are out of force go, and others carry warnings. Blank queries find nothing.
    """
    asked = written(queries.select("query", "text").where("trim(coalesce(text, '')) <> ''"), "search-queries")
    allowed = written(chunks.where(retrieval.chunk_filter(**(DEFAULTS | (filters or {})))).select("key"), "search-allowed")
    terms = asked.select("query", retrieval.query_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    a = index.search(spark, text_index, terms, LIST, digits=digits, allowed=allowed)
    b = a.limit(0)
    if embedder is not None and cells_path is not None:
        wanted = asked.where(retrieval.search_mode(F.col("text")) == "HYBRID")
        b = cells.search(spark, cells_path, embedder(wanted), LIST, digits=digits, allowed=allowed)
    rows = retrieval.fuse(a, b, "key").join(chunks, "key")
    if edges is not None:
        rows = graph.valid_only(rows, edges)
    most = chunks.agg(F.max("uses").alias("_most"))  # one row
    day = days_since(F.col("issue_date"), as_of if as_of is not None else F.current_date())
    final = retrieval.final_score(F.col("rrf"), day, F.coalesce("uses", F.lit(0)), F.col("_most"))
    scored = rows.join(F.broadcast(most)).withColumn("final", F.round(final, digits) if digits is not None else final).drop("_most")
    return retrieval.ranked(scored, [F.desc("final"), F.col("rank_a").asc_nulls_last(), F.col("key")], limit, "pos")


def profiles(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """(code, centroid, mean, sd): an industry's centroid from its sample vectors (code, v), calibrated on all vectors (v)."""
    c = impact.as_vectors(impact.centroids(samples, "code", "v"), "code")
    cos = retrieval.met(vectors.select("v"), c, "code").select("code", cosine(F.col("v"), F.col("centroid")).alias("cos"))
    return c.join(cos.groupBy("code").agg(F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sd")), "code")


def impact_batch(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, known: DataFrame, lexicon: DataFrame, version: str, path: str | None = None) -> DataFrame:
    """(doc, code, restrictions, rel_lexicon, rel_embedding, relevance, impact_raw, impact_pct_doc, pct_industry, scorer_version).

    documents: doc, title, field, level, is_business; chunks: doc, chunk, content; vectors: doc, chunk, v; known: profiles;
    lexicon: (code, term). A document's restrictions are those of its chunks; one layer that knows nothing of a document leaves it to
    the other. Percentiles count against business documents of the industry. With a path the version's rows are replaced there.
    """
    counted = chunks.groupBy("doc").agg(F.sum(phrases.weighted_total(F.col("content"))).alias("restrictions"), F.array_sort(F.collect_list(F.struct("chunk", "content"))).alias("_c"))
    d = written(documents.join(counted, "doc", "left").withColumn("_body", F.array_join(F.transform("_c", lambda c: c["content"]), "\n")).drop("_c"), "impact-documents")
    scores = phrases.class_scores(d, "doc", F.col("title"), F.col("field"), F.col("_body"), lexicon, least=1)
    by_words = impact.shares(scores.select("doc", "code", F.col("score").cast("double").alias("s")), "doc", "s", "rel")
    z = retrieval.met(vectors.select("doc", "chunk", "v"), known, "code").withColumn("z", zscore(cosine(F.col("v"), F.col("centroid")), F.col("mean"), F.col("sd")))
    best = impact.best_mean(z, ["doc", "code"], "z", ["chunk"])
    by_vectors = best.withColumn("rel", impact.softmax("score", "doc")).select("doc", F.col("code").cast("string").alias("code"), "rel")
    fused = impact.fused(by_words, by_vectors, "doc", "code")
    facts = d.select("doc", F.coalesce("restrictions", F.lit(0.0)).alias("restrictions"), "level", "is_business")
    scored = impact.impact(fused.join(facts, "doc"), "doc")
    out = impact.percentile_vs_reference(scored, "code", "impact_raw", F.coalesce("is_business", F.lit(False)), "pct_industry")
    out = out.select("doc", "code", "restrictions", "rel_lexicon", "rel_embedding", "relevance", "impact_raw", "impact_pct_doc", "pct_industry").withColumn("scorer_version", F.lit(version))
    if path is not None:
        out = written(out, "impact-rows")
        sinks.overwrite_version(out, path)
    return out


def daily_ingest(spark: SparkSession, pages: str, table: Table, history: Table, text_index: str, floor: str, batch: int, overlap_days: int = 45, cap: int = paged.CAP) -> dict:
    """Read the registry's new pages, merge their documents, write status changes, take new texts into the index.

    The scan goes back to `overlap_days` before the newest date that the table knows, never before `floor`. Documents are
    keyed by number and agency. Status changes go to `history` before the table is merged, so that a run that
    was lost in between finds them again; a batch that was applied already changes nothing. Returns counts.
    """
    there = bool(generations(spark, table.path))
    high = table.read(spark).agg(F.max("issue_date")).first()[0] if there else None
    cutoff = max(floor, str(spark.range(1).select(F.date_sub(F.lit(high), overlap_days)).first()[0])) if high else floor
    rows = paged.scan(spark, pages, cutoff, cap)
    bad = rows.where("error IS NOT NULL").count()
    items = rows.where("error IS NULL").select(F.from_json("item", f"struct<{payloads._inline(payloads.ITEM)}>").alias("i")).select("i.*").where("trim(coalesce(docNum, '')) <> ''")
    new = payloads.document_rows(items).withColumn("level", hierarchy(F.col("doc_num"))["level"])
    new = new.withColumn("agency_name", F.coalesce("agency_name", F.lit("")))
    new = written(new.withColumn("digest", F.sha2(F.to_json(F.struct("title", "eff_status", "html")), 256)).dropDuplicates(["doc_num", "agency_name"]), "ingest-rows")
    key = ["doc_num", "agency_name"]
    if there:
        old = table.read(spark).select(*key, F.col("digest").alias("_digest"), F.col("eff_status").alias("_status"))
        j = new.join(old, key, "left")
    else:
        j = new.withColumn("_digest", F.lit(None).cast("string")).withColumn("_status", F.lit(None).cast("string"))
    fresh = written(j.where("_digest IS NULL OR _digest <> digest"), "ingest-fresh")
    changed = fresh.where("_status IS NOT NULL AND eff_status IS NOT NULL AND _status <> eff_status")
    history.apply(changed.select(*key, F.lit(batch).cast("long").alias("batch"), F.col("_status").alias("old_status"), F.col("eff_status").alias("new_status")), batch)
    counts = {"read": new.count(), "new": fresh.where("_digest IS NULL").count(), "changed": fresh.where("_digest IS NOT NULL").count(), "status_changes": changed.count(), "bad_pages": bad, "cutoff": cutoff}
    texts = fresh.select(F.concat_ws("::", *key).alias("key"), F.concat_ws("\n", "doc_num", "title", "html").alias("text"))
    counts["applied"] = table.apply(fresh.drop("_digest", "_status"), batch)
    if generations(spark, text_index):
        index.update(spark, text_index, texts, "key", F.col("text"))
    else:
        index.build(texts, "key", F.col("text"), text_index)
    return counts
