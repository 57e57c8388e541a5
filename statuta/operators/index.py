"""A kept inverted index: searches read postings, never texts.

Documents are dealt by key, put in order of their characters inside each part and cut into blocks of 64. A task makes the
rows of its blocks, so what is shuffled is each text once and each posting once. A posting row is a term in a block: the entries
(key, count, length), and of these the largest count and the smallest length, which bound the term's share of the score of
any document there, whatever the corpus is by then. Postings are range-partitioned and sorted by term, so a search for
a few terms skips the files of all others.

Changes are generations: new and changed documents get new blocks, old versions are listed as dead, and the
counts of documents by term are differences that add up. Scores after any changes are those of an index made anew,
for they come from the number of documents, of words and of documents by term alone. compact() writes one generation
without the dead.

A search takes every query's blocks by their bound: first a few, then those whose bound reaches the score of the last
of the list so far. Blocks below it can't hold a hit and are never read, so lists are exact.

Nulls: a null text is an empty one, a row without a key is left out. Of rows of one key that of the largest digest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.kept import generations, light, load, save
from statuta.operators.retrieval import K1, MOST_TERMS, B, tokens
from statuta.session import dropped, written

#: Texts of an Arrow batch where blocks are made.
BATCH = 256
#: Documents of a block; blocks a query that are read first, and the most that are taken by rank.
BLOCK_BITS, FIRST, MOST = 6, 16, 4096
#: What a bound may be too low by, from the order of additions.
ERROR = 1e-9


def documents(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, digest, words) of the rows that an index holds."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).where("key IS NOT NULL")
    return rows.withColumn("digest", F.sha2("text", 256))


def _inverted(gen: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a block, and one without a term that lists the block's documents with their digests.

    Rows (key, digest, block, words) come block by block; a block that a batch cuts waits for the rest. What is held
    follows a block, not the batch.
    """
    left = None
    for b in batches:
        t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b], left.schema)])
        starts = [*np.flatnonzero(np.diff(t["block"].to_numpy(), prepend=-1)).tolist(), t.num_rows]
        for first, end in pairwise(starts[:-1]):
            yield from _postings(gen, t.slice(first, end - first))
        left = t.slice(starts[-2]) if t.num_rows else left  # the last block may go on
    if left is not None:
        yield from _postings(gen, left)


def _postings(gen: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of one block."""
    key, digest, words = (t[c].combine_chunks() for c in ("key", "digest", "words"))
    block, docs = t["block"][0].as_py(), t.num_rows
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype("int32")
    term = pc.list_flatten(words).dictionary_encode()
    # One number for each term and document, so equal numbers are a term's places in a document.
    found, tf = np.unique(term.indices.to_numpy().astype("int64") * docs + np.repeat(np.arange(docs), size), return_counts=True)
    code, doc = found // docs, found % docs

    def rows(terms: pa.Array, doc: np.ndarray, tf: np.ndarray, first: np.ndarray, digests: pa.Array) -> pa.RecordBatch:
        each = pa.StructArray.from_arrays([key.take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(size[doc], pa.int32())], ["key", "tf", "len"])
        ends = np.append(first, len(doc))
        facts = [np.full(len(first), gen, "int32"), np.full(len(first), block, "int64"), np.diff(ends).astype("int64"), np.maximum.reduceat(tf, first), np.minimum.reduceat(size[doc], first)]
        columns = [terms, *map(pa.array, facts), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), digests]
        return pa.RecordBatch.from_arrays(columns, ["term", "gen", "block", "n", "tf_max", "len_min", "entries", "digests"])

    yield rows(pa.nulls(1, pa.string()), np.arange(docs), np.zeros(docs, "int64"), np.array([0]), pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), digest))
    if len(found):
        first = np.flatnonzero(np.diff(code, prepend=-1))
        yield rows(term.dictionary.take(pa.array(code[first])), doc, tf, first, pa.nulls(len(first), pa.list_(pa.string())))


def _generation(spark: SparkSession, path: str, number: int, fresh: DataFrame, dead: DataFrame, lost: DataFrame, before: tuple[int, int]) -> None:
    """Write a generation: fresh (key, digest, text), dead (key, gen, block, len), lost (term, df: what the dead had)."""
    # Texts come dealt by key and are put in order inside each part, so blocks of like lengths form where texts lie.
    placed = fresh.withColumn("_chars", F.length("text")).sortWithinPartitions("_chars", "key").withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select("key", "digest", F.shiftright("_at", BLOCK_BITS).alias("block"), tokens(F.col("text")).alias("words"))
    kind = fresh.schema["key"].dataType.simpleString()
    form = f"term string, gen int, block long, n long, tf_max long, len_min int, entries array<struct<key:{kind},tf:bigint,len:int>>, digests array<string>"
    blocks = written(placed.mapInArrow(partial(_inverted, number), form), "index-blocks", BATCH)
    listed = blocks.where("term IS NULL").select("gen", "block", F.explode(F.arrays_zip("entries", "digests")).alias("d"))
    rows = blocks.where("term IS NOT NULL").drop("digests")
    rows = save(rows.repartitionByRange("term", "gen", "block").sortWithinPartitions("term", "gen", "block"), path, number, "postings")
    gained = rows.groupBy("term").agg(F.sum("n").alias("df"))
    terms = gained.unionByName(lost.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    save(terms.repartitionByRange("term").sortWithinPartitions("term"), path, number, "terms")
    gone = save(dead.select("key", "gen", "block", "len"), path, number, "dead")
    mine = save(listed.select("d.entries.key", F.col("d.digests").alias("digest"), "d.entries.len", "gen", "block"), path, number, "docs")
    dropped(blocks)
    total = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first())
    (more, long), (less, short) = total(mine), total(gone)
    whole = spark.createDataFrame([(before[0] + more - less, before[1] + long - short)], "docs long, words long")
    save(whole, path, number, "whole")


def build(docs: DataFrame, key: str, text: Column, path: str) -> str:
    """Make the index of a table under a path that holds none."""
    spark = docs.sparkSession
    if generations(spark, path):
        raise ValueError(f"an index is there already: {path}")
    rows = documents(docs, key, text)
    one = rows.groupBy("key").agg(F.max_by(F.struct("digest", "text"), "digest").alias("_r")).select("key", "_r.*")
    none = spark.createDataFrame([], "gen int, block long, len int").select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "*")
    _generation(spark, path, 0, one, none, spark.createDataFrame([], "term string, df long"), (0, 0))
    return path


def _live(spark: SparkSession, path: str, found: list[int]) -> DataFrame:
    dead = load(spark, path, found, "dead").select("key", "gen", "block")
    return load(spark, path, found, "docs").join(dead, ["key", "gen", "block"], "left_anti")


def update(spark: SparkSession, path: str, upserts: DataFrame, key: str, text: Column, deleted: DataFrame | None = None) -> int:
    """Take new, changed and deleted documents (a table with the key) in: the new generation's number.

    A document of unchanged content (by digest) is skipped. Texts of other documents aren't read, and of the index
    the postings once, to count what the dead take away.
    """
    found = generations(spark, path)
    if not found:
        raise ValueError(f"no index: {path}")
    before = load(spark, path, found[-1:], "whole").first()
    live = _live(spark, path, found)
    rows = documents(upserts, key, text)
    one = rows.groupBy("key").agg(F.max_by(F.struct("digest", "text"), "digest").alias("_r")).select("key", "_r.*")
    fresh = written(one.join(live.select("key", "digest"), ["key", "digest"], "left_anti"), "index-fresh")
    away = fresh.select("key")
    if deleted is not None:
        # A document that is deleted and comes in the same change stays as it comes.
        away = away.unionByName(deleted.select(F.col(key).alias("key")).join(one.select("key"), "key", "left_anti")).distinct()
    dead = written(live.join(light(away), "key", "left_semi"), "index-dead")
    had = load(spark, path, found, "postings").join(light(dead.select("gen", "block").distinct()), ["gen", "block"], "left_semi")
    e = had.select("term", "gen", "block", F.explode("entries.key").alias("key")).join(light(dead.select("key", "gen", "block")), ["key", "gen", "block"], "left_semi")
    _generation(spark, path, found[-1] + 1, fresh, dead, e.groupBy("term").agg(F.count("*").alias("df")), tuple(before))
    return found[-1] + 1


def compact(spark: SparkSession, path: str, to: str) -> str:
    """Write the index as one generation without dead documents under another path. No text is read."""
    found = generations(spark, path)
    live = save(_live(spark, path, found), to, 0, "docs")
    e = load(spark, path, found, "postings").select("term", "gen", "block", F.explode("entries").alias("e"))
    e = e.select("*", F.col("e.key").alias("key")).join(light(load(spark, path, found, "dead").select("key", "gen", "block")), ["key", "gen", "block"], "left_anti")
    rows = e.groupBy("term", "gen", "block").agg(F.count("*").alias("n"), F.max("e.tf").alias("tf_max"), F.min("e.len").alias("len_min"), F.array_sort(F.collect_list("e")).alias("entries"))
    rows = save(rows.repartitionByRange("term", "gen", "block").sortWithinPartitions("term", "gen", "block"), to, 0, "postings")
    save(rows.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term"), to, 0, "terms")
    save(load(spark, path, found[-1:], "dead").limit(0), to, 0, "dead")
    save(live.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")), to, 0, "whole")
    return to


def share(tf: Column, length: Column) -> Column:
    """A term's part of a score but for its weight: grows with its count, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("mean")))


def search(
    spark: SparkSession, path: str, queries: DataFrame, limit: int, all_terms: bool = True, digits: int | None = None, allowed: DataFrame | None = None, seen: dict | None = None
) -> DataFrame:
    """(query, key, score, rank): the best `limit` documents of each query, ties to the smaller key.

    queries: (query, terms), at most MOST_TERMS distinct terms. With all_terms a hit holds all terms of its query, else
    any. Scores are rounded to `digits` before they are ranked, if given. allowed: the keys that may be hits; the
    limit counts what is left of them. seen: gets the numbers of matching postings and of those that were read.
    """
    found = generations(spark, path)
    if not found:
        raise ValueError(f"no index: {path}")
    asked = queries.select("query", F.array_distinct("terms").alias("terms"))
    asked = asked.select("query", F.size("terms").alias("want"), F.explode("terms").alias("term"))
    terms = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} distinct search terms at a time")
    postings = load(spark, path, found, "postings").where(F.col("term").isin(*terms))
    df = load(spark, path, found, "terms").where(F.col("term").isin(*terms)).groupBy("term").agg(F.sum("df").alias("df"))
    docs, words = load(spark, path, found[-1:], "whole").first()
    weight = F.greatest(F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    mean = float(words) / docs if docs and words else 1.0
    facts = written(asked.join(F.broadcast(df), "term").select("query", "term", "want", weight.alias("weight"), F.lit(mean).alias("mean")), "index-asked")
    facts = light(facts)
    heads = postings.select("term", "gen", "block", "n", "tf_max", "len_min").join(facts, "term")
    plan = heads.groupBy("query", "gen", "block").agg(F.sum(F.col("weight") * share(F.col("tf_max"), F.col("len_min"))).alias("bound"), F.count("*").alias("_have"), F.max("want").alias("_want"), F.sum("n").alias("n"))
    plan = written(plan.where("_have = _want" if all_terms else "true").drop("_have", "_want"), "index-plan")
    several = len(found) > 1

    def exact(blocks: DataFrame) -> DataFrame:
        need = blocks.select("query", "gen", "block").join(facts, "query")
        rows = postings.select("term", "gen", "block", "entries").join(light(need), ["term", "gen", "block"])
        e = rows.select("query", "want", "weight", "mean", "gen", "block", F.explode("entries").alias("e")).select("query", "want", "weight", "mean", "gen", "block", "e.*")
        if several:
            e = e.join(light(load(spark, path, found, "dead").select("key", "gen", "block")), ["key", "gen", "block"], "left_anti")
        if allowed is not None:
            e = e.join(light(allowed.select(F.col(allowed.columns[0]).alias("key")).distinct()), "key", "left_semi")
        g = e.groupBy("query", "key", "want").agg(F.sum(F.col("weight") * share(F.col("tf"), F.col("len"))).alias("score"), F.count("*").alias("_have"))
        g = (g.where("_have = want") if all_terms else g).select("query", "key", "score")
        return g.withColumn("score", F.round("score", digits)) if digits is not None else g

    def best(hits: DataFrame) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
        return hits.withColumn("rank", r).where(F.col("rank") <= limit)

    slack, m = max(ERROR, 10.0**-digits if digits is not None else 0), FIRST
    while True:
        r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "gen", "block"))
        first = plan.withColumn("_r", r).where(F.col("_r") <= m)
        hits = written(best(exact(first)), "index-hits")
        floors = hits.where(F.col("rank") == limit).select("query", F.col("score").alias("floor"))
        open_ = plan.join(light(floors), "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - slack))
        left = open_.join(light(first.select("query", "gen", "block")), ["query", "gen", "block"], "left_anti")
        more = left.count()
        if not more or m >= MOST or more <= first.count():
            break
        m *= 4
    if seen is not None:
        took = written((first.drop("_r") if not more else first.drop("_r").unionByName(open_.drop("floor"))).select("query", "gen", "block", "n").distinct(), "index-read")
        seen |= {"postings": plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "read": took.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
    return hits if not more else best(exact(open_))
