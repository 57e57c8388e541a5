"""Citation graphs: hops, cascades, impacts, validity, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.session import written

#: Relations that end or amend their target, statuses, and weights of relations for a crawl.
ENDING = ("Bãi bỏ", "Hủy bỏ", "Thay thế", "Đình chỉ")
AMENDING = ("Sửa đổi, bổ sung",)
EXPIRED = ("hết hiệu lực toàn bộ", "hết hiệu lực")
WEIGHTS = {"Sửa đổi, bổ sung": 3.0, "Thay thế": 3.0, "Bãi bỏ": 3.0, "Hủy bỏ": 3.0, "Đình chỉ": 3.0, "Căn cứ": 1.0}
OTHER_WEIGHT = 0.5


def hops(edges: DataFrame, seeds: DataFrame, limit: int | None = None, directed: bool = False) -> DataFrame:
    """(node, depth): fewest edges (src, dst) from any seed (column node); `limit` hops at most.

    One join a hop; a node is expanded once, so cycles end by themselves.
    """
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = written(e.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "hops-edges")
    seen = front = written(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "hops-seeds")
    depth = 0
    while limit is None or depth < limit:
        depth += 1
        reached = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "hops-front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def cascade(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Distinct edges that touch a node less than `depth` hops from a seed, whatever their direction."""
    inner = hops(edges, seeds, depth - 1).select("node")
    a = edges.join(inner, edges["src"] == inner["node"], "left_semi")
    b = edges.join(inner, edges["dst"] == inner["node"], "left_semi")
    return a.unionAll(b).distinct()


def impacts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, relation, direction) of all edges of the nodes, both ways; nothing is merged."""
    out = nodes.join(edges, nodes["node"] == edges["src"]).select("node", F.col("dst").alias("other"), "relation", F.lit("forward").alias("direction"))
    reverse = F.concat(F.lit("bị "), F.lower("relation"), F.lit(" bởi"))
    back = nodes.join(edges, nodes["node"] == edges["dst"]).select("node", F.col("src").alias("other"), reverse.alias("relation"), F.lit("backward").alias("direction"))
    return out.unionAll(back)


def acting_on(edges: DataFrame, relations: tuple[str, ...], name: str) -> DataFrame:
    """(node, name): sorted distinct sources of the given relations on each target."""
    return edges.where(F.col("relation").isin(*relations)).groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias(name))


def valid_only(chunks: DataFrame, edges: DataFrame, ending: tuple[str, ...] = ENDING, amending: tuple[str, ...] = AMENDING, expired: tuple[str, ...] = EXPIRED) -> DataFrame:
    """Chunks (doc, status, …) of documents neither expired nor ended by another, with warnings.

    Chunks without a document pass.
    """
    ended = edges.where(F.col("relation").isin(*ending)).select(F.col("dst").alias("_e")).distinct()
    live = chunks.where(~F.coalesce(F.lower("status").isin(*expired), F.lit(False))).join(ended, F.col("doc") == F.col("_e"), "left_anti")
    amended = acting_on(edges, amending, "_by").withColumnRenamed("node", "_n")
    low = F.lower("status")
    notes = F.array_compact(F.array(
        F.when(F.contains(low, F.lit("một phần")), F.lit("partly out of force")),
        F.when(F.contains(low, F.lit("chưa")), F.lit("not yet in force")),
        F.when(F.size("_by") > 0, F.concat(F.lit("amended by: "), F.array_join("_by", ", "))),
    ))
    return live.join(amended, F.col("doc") == F.col("_n"), "left").withColumn("warnings", F.array_join(notes, " | ")).drop("_n", "_by")


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


def relation_weight(relation: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])
    return F.coalesce(F.try_element_at(known, relation), F.lit(OTHER_WEIGHT))


def crawl_priority(weight: Column, in_degree: Column, depth: Column) -> Column:
    """3 * relation weight + 2 * ln(1 + in-degree) - 1.5 * depth."""
    return 3 * weight + 2 * F.log1p(F.greatest(F.lit(0), in_degree).cast("double")) - 1.5 * depth


def frontier(refs: DataFrame, sources: DataFrame, known: DataFrame, queued: DataFrame, max_depth: int = 0, junk: tuple[str, ...] = ("Không số", "Khong so", "", "-")) -> DataFrame:
    """New crawl targets: (target, number, relation, in_degree, depth).

    refs (source, target, number, relation), sources (source, source_ext, depth), known (target),
    queued (target, state). Targets known or queued go; so do references of hub sources. A source
    of null source_ext counts as long as there is no hub at all, as in SQL's NOT IN.
    """
    hubs = queued.where("state = 'HUB_NOT_EXPANDED'").select(F.col("target").alias("_hub"))
    j = refs.where("target IS NOT NULL AND target <> ''").join(sources, "source")
    j = j.join(known.select("target").distinct(), "target", "left_anti").join(queued.select("target").distinct(), "target", "left_anti")
    some = hubs.agg((F.count("*") > 0).alias("_some"))
    j = j.join(F.broadcast(some)).where("NOT _some OR source_ext IS NOT NULL").drop("_some")  # one row
    j = j.join(hubs, j["source_ext"] == hubs["_hub"], "left_anti")
    out = j.groupBy("target", "number").agg(F.min("relation").alias("relation"), F.count("*").alias("in_degree"), (F.min(F.coalesce("depth", F.lit(0))) + 1).alias("depth"))
    out = out.where(~F.trim(F.coalesce("number", F.lit(""))).isin(*junk))
    return out.where(F.col("depth") <= max_depth) if max_depth else out


def closure(edges: DataFrame, store: DataFrame, seeds: DataFrame, cap: int, hub: int = 200) -> DataFrame:
    """(node, depth, state): crawl by rounds over landed documents.

    Nodes in `store` (column node) are DONE, others NO_ID; a node cited over `hub` times is
    HUB_NOT_EXPANDED and not followed; nodes past `cap` hops are TOO_DEEP.
    """
    hubs = written(in_degrees(edges).where(F.col("in_degree") > hub).select("node"), "closure-hubs")
    kept = edges.join(hubs, edges["src"] == hubs["node"], "left_anti")
    reached = hops(kept, seeds, cap + 1, directed=True)
    s = store.select(F.col("node").alias("_s")).distinct()
    out = reached.join(s, reached["node"] == s["_s"], "left").join(hubs.withColumn("_hub", F.lit(True)), "node", "left")
    state = F.when(F.col("depth") > cap, "TOO_DEEP").when(F.col("_hub"), "HUB_NOT_EXPANDED").when(F.col("_s").isNotNull(), "DONE").otherwise("NO_ID")
    return out.select("node", "depth", state.alias("state"))
