"""The closure loop: documents that others cite are fetched by priority until a budget, the queue or a cap ends it.

State lies in generations under a path (see kept): the queue with every target's state, attempts and error, the documents with
their depth, and counters. Each step of the loop is a generation, so a run that was stopped or lost goes on where it was.

A round takes the `batch` targets of the highest priority, fetches them (a join with the landed documents), and queues
what the new ones cite. A budget may end in the middle of a round: the next run first ends that round, so two runs with half of a
budget do what one does with all of it. Only references of documents that came in the round are looked at for new targets; what
they cite is counted over all references of known documents.

States: PENDING, DONE, HUB_NOT_EXPANDED (fetched, but cited too often to be followed), FAILED (not there, or it
can't be read; see retry), NO_ID (a number that says nothing). Ties of priority go to the smaller depth, then the smaller target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.graph import crawl_priority, relation_weight
from statuta.operators.kept import generations, light, load, save
from statuta.session import written

#: Numbers that say nothing, citations past which a document isn't followed, documents at most.
JUNK, HUB, NODES = ("Không số", "Khong so", "", "-"), 200, 15_000
PENDING, DONE, HUBS, FAILED, NO_ID = "PENDING", "DONE", "HUB_NOT_EXPANDED", "FAILED", "NO_ID"
#: Targets of a round at most: one task puts them in order.
MOST_BATCH = 100_000
QUEUE = ("target", "number", "relation", "in_degree", "depth", "priority", "state", "attempts", "error", "round")
COUNTS = ("fetched", "failed", "hubs", "junk", "enqueued")


def _junk(number):
    return F.trim(F.coalesce(number, F.lit(""))).isin(*JUNK)


def _found(refs: DataFrame, documents: DataFrame, queue: DataFrame, fresh: DataFrame, max_depth: int) -> DataFrame:
    """New rows of the queue: what the fresh documents cite and nobody knows yet."""
    mine = refs.join(light(fresh.select(F.col("node").alias("source"))), "source", "left_semi").where("target IS NOT NULL AND target <> ''")
    new = mine.select("target").distinct().join(documents.select(F.col("node").alias("target")), "target", "left_anti").join(queue.select("target"), "target", "left_anti")
    new = written(new, "crawl-new")
    hubs = queue.where(F.col("state") == HUBS).select(F.col("target").alias("node"))
    sources = documents.join(light(hubs), "node", "left_anti").select(F.col("node").alias("source"), F.col("depth").alias("_d"))
    cited = written(refs.join(light(new), "target", "left_semi"), "crawl-cited").join(sources, "source")
    g = cited.groupBy("target", "number").agg(F.min("relation").alias("relation"), F.count("*").alias("in_degree"), (F.min(F.coalesce("_d", F.lit(0))) + 1).alias("depth"))
    g = g.where(~_junk(F.col("number")))
    g = g.where(F.col("depth") <= max_depth) if max_depth else g
    # A target of several numbers is queued by the one that is cited most.
    one = g.groupBy("target").agg(F.min_by(F.struct("number", "relation", "in_degree", "depth"), F.struct(-F.col("in_degree"), "number")).alias("g")).select("target", "g.*")
    priority = crawl_priority(relation_weight(F.col("relation")), F.col("in_degree"), F.col("depth"))
    return one.select("target", "number", "relation", "in_degree", F.col("depth").cast("int").alias("depth"), priority.alias("priority"), F.lit(PENDING).alias("state"),
                      F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("round"))


def _save(path: str, number: int, queue: DataFrame, documents: DataFrame, counts: dict) -> None:
    save(queue.select(*QUEUE), path, number, "queue")
    save(documents.select("node", "depth", "round"), path, number, "documents")
    spark = queue.sparkSession
    save(spark.createDataFrame([tuple(counts[c] for c in ("round", *COUNTS))], ", ".join(f"{c} long" for c in ("round", *COUNTS))), path, number, "whole")


def start(path: str, seeds: DataFrame, refs: DataFrame, max_depth: int = 0) -> str:
    """Begin with seeds (node, depth or null); refs (source, target, number, relation) are those of all landed documents."""
    spark = seeds.sparkSession
    if generations(spark, path):
        raise ValueError(f"a crawl is there already: {path}")
    documents = written(seeds.groupBy("node").agg(F.min("depth").cast("int").alias("depth")).where("node IS NOT NULL").withColumn("round", F.lit(0)), "crawl-seeds")
    none = spark.createDataFrame([], "target string, number string, relation string, in_degree long, depth int, priority double, state string, attempts int, error string, round int")
    queue = written(_found(refs, documents, none, documents, max_depth), "crawl-queue")
    _save(path, 0, queue, documents, {"round": 0} | dict.fromkeys(COUNTS, 0) | {"enqueued": queue.count()})
    return path


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(queue, documents, counters) as they are."""
    found = generations(spark, path)
    if not found:
        raise ValueError(f"no crawl: {path}")
    return load(spark, path, found[-1:], "queue"), load(spark, path, found[-1:], "documents"), load(spark, path, found[-1:], "whole").first().asDict()


def run(spark: SparkSession, path: str, refs: DataFrame, store: DataFrame, budget: int, batch: int = 20, nodes: int = NODES, hub: int = HUB, max_depth: int = 0,
        on_documents: Callable[[DataFrame], None] | None = None) -> dict:
    """Go on until `budget` documents were fetched, nothing is pending or there are `nodes` documents.

    store: (node, number, error) of the landed documents; one with an error, or that isn't there, fails. on_documents gets
    the fetched ones (node, depth, round) of every step before its state is saved: after a lost run it gets a step again. Returns
    the counters of this run, why it stopped and what is pending.
    """
    if not 0 < batch <= MOST_BATCH:
        raise ValueError(f"a batch holds 1 to {MOST_BATCH} targets")
    queue, documents, counts = state(spark, path)
    begun, number, why = dict(counts), generations(spark, path)[-1], ""
    order = [F.desc("priority"), F.col("depth"), F.col("target")]
    while counts["fetched"] - begun["fetched"] < budget:
        mine = (F.col("round") == counts["round"]) & (F.col("state") == PENDING) & (F.col("round") > 0)
        if queue.where(mine).isEmpty():
            if documents.count() >= nodes:
                why = "node cap"
                break
            chosen = written(queue.where(F.col("state") == PENDING).orderBy(*order).limit(batch).select("target"), "crawl-batch")
            if chosen.isEmpty():
                why = "queue empty"
                break
            counts["round"] += 1
            taken = light(chosen.withColumn("_taken", F.lit(True)))
            queue = written(queue.join(taken, "target", "left").withColumn("round", F.when(F.col("_taken"), F.lit(counts["round"])).otherwise(F.col("round")).cast("int")).drop("_taken"), "crawl-queue")
            mine = (F.col("round") == counts["round"]) & (F.col("state") == PENDING)
        open_ = written(queue.where(mine), "crawl-open")  # a batch at most
        there = store.join(light(open_.select(F.col("target").alias("node"))), "node", "left_semi").groupBy("node").agg(F.min_by(F.struct(F.col("number").alias("own"), F.col("error").alias("fault")), F.struct(F.col("error").isNotNull(), "number", "error")).alias("_s"))
        got = open_.join(there, F.col("target") == F.col("node"), "left")
        names = F.coalesce(F.nullif(F.trim("number"), F.lit("")), F.col("_s.own"))
        fault = F.when(F.col("node").isNull(), "not found").otherwise(F.col("_s.fault"))
        got = got.select("target", *[c for c in QUEUE if c not in ("target", "error", "state")], names.alias("_name"), F.when(_junk(F.col("number")), NO_ID).when(fault.isNotNull(), FAILED).otherwise(DONE).alias("state"),
                         F.when(_junk(F.col("number")), "junk number").otherwise(fault).alias("error"))
        earlier = F.coalesce(F.sum(F.when(F.col("state") == DONE, 1).otherwise(0)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = budget - (counts["fetched"] - begun["fetched"])
        got = written(got.withColumn("_before", earlier).where(F.col("_before") < left), "crawl-got")
        known = refs.select("source", F.col("number").alias("_name")).join(light(got.select("_name").distinct()), "_name", "left_semi").join(documents.select(F.col("node").alias("source")), "source", "left_semi")
        degree = light(written(known.groupBy("_name").agg(F.count("*").alias("_degree")), "crawl-degrees"))
        got = got.join(degree, "_name", "left").withColumn("state", F.when((F.col("state") == DONE) & (F.coalesce("_degree", F.lit(0)) > hub), HUBS).otherwise(F.col("state")))
        got = written(got.withColumn("attempts", F.col("attempts") + 1).select(*QUEUE), "crawl-done")
        queue = queue.join(light(got.select("target")), "target", "left_anti").unionByName(got)
        fetched = got.where(F.col("state").isin(DONE, HUBS)).select(F.col("target").alias("node"), "depth", "round")
        documents = documents.unionByName(fetched)
        if on_documents is not None:
            on_documents(fetched)
        tally = {r["state"]: r["n"] for r in got.groupBy("state").agg(F.count("*").alias("n")).collect()}
        counts["fetched"] += tally.get(DONE, 0) + tally.get(HUBS, 0)
        for name, key in (("failed", FAILED), ("hubs", HUBS), ("junk", NO_ID)):
            counts[name] += tally.get(key, 0)
        queue, documents = written(queue, "crawl-queue"), written(documents, "crawl-documents")
        if queue.where((F.col("round") == counts["round"]) & (F.col("state") == PENDING)).isEmpty():
            # The round is over: what its documents cite is queued, but for those that are hubs.
            more = written(_found(refs, documents, queue, documents.where(F.col("round") == counts["round"]), max_depth), "crawl-more")
            counts["enqueued"] += more.count()
            queue = queue.unionByName(more)
        number += 1
        _save(path, number, queue, documents, counts)
        queue, documents, counts = state(spark, path)
    done = {c: counts[c] - begun[c] for c in COUNTS}
    return done | {"stopped": why or "budget", "pending": queue.where(F.col("state") == PENDING).count()}


def retry(spark: SparkSession, path: str, attempts: int = 3) -> int:
    """Put failed targets of fewer attempts back into the queue; how many."""
    queue, documents, counts = state(spark, path)
    again = (F.col("state") == FAILED) & (F.col("attempts") < attempts)
    n = queue.where(again).count()
    if n:
        back = queue.withColumn("round", F.when(again, 0).otherwise(F.col("round"))).withColumn("error", F.when(~again, F.col("error"))).withColumn("state", F.when(again, PENDING).otherwise(F.col("state")))
        _save(path, generations(spark, path)[-1] + 1, written(back, "crawl-queue"), documents, counts)
    return n
