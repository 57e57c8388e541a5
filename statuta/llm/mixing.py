"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame operations only.

Every source's documents are shuffled and cut into blocks of `block_words` words; a source whose
target is small has smaller ones, about 256 to its target, so that a block is always a small share of
it. Slot n of the schedule has the golden-ratio point frac(n * phi), taken in 31-bit integers; the
point falls into one source's interval of the cumulative numbers of slots, the slots of a source
are ranked, and slot k of a source takes its block k modulo its number of blocks. A source has as
many slots as come nearest to its target; where the points give it a few less, these follow at the
end. After any prefix of the schedule each source has its share up to a few blocks, and in the end
its target up to half a block.

Nulls: a null text has size 0, a null source is a source of its own (last), a null doc_id is kept.
Repeated rows count as separate documents. Ties: documents of one source follow each other by a
hash, then doc_id and text. A document of size 0 is returned with taken 0; a text of any length is
cut at block borders. An empty table gives an empty result. Columns other than doc_id, text and
source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from statuta.llm.common import fresh, grouped_prefix, prefix_sums, with_global_index, written

WORD = r"[^\x20\x09-\x0D]+"
#: 2**31 / golden ratio, made odd, so that n * STEP mod 2**31 visits every point once a period.
STEP, PERIOD = 1327217885, 1 << 31
EPOCHS = 3
#: Slots ranked by one window task, cells of the grid that maps points to intervals, blocks of a small
#: target, sources up to which their table is broadcast.
CHUNK, CELLS, BLOCKS, FEW = 1 << 14, 1 << 12, 256, 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, cap: float = EPOCHS) -> DataFrame:
    """Rows (source, rank, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share all words by weight;
    a target stops at cap times its source's size and the excess is reshared by weight. The level
    at which that settles is found by a few sums over the one-row-per-source table.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_global_index(sizes, [F.col("source").isNull(), F.col("source")], "rank", "mix-sources", 8)
    s = written(
        ranked.select("source", "rank", "source_size", (F.col("rank") % 3 + 1).cast("double").alias("_w"), (F.col("source_size") * cap).alias("_cap")),
        "mix-weights",
    )
    total, weights = s.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped = (float(total) / weights if total else 0.0), 0
    while total:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, caps, w = s.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(full, F.col("_w")))).first()
        if n == capped or w == weights:
            break
        capped, level = n, (total - caps) / (weights - w)
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w"))
    return s.select("source", "rank", "source_size", target.alias("target"))


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """targets with block (words), blocks (of the source) and slots (blocks that the mix takes)."""
    t = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / BLOCKS))).cast("long"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round((F.col("target") - whole * F.col("source_size")) / F.col("block"))
    return t.withColumn("slots", (whole * F.col("blocks") + F.least(rest, F.col("blocks"))).cast("long"))


def source_schedule(targets: DataFrame) -> DataFrame:
    """Rows (slot, source, epoch, block): the order in which the mix takes blocks."""
    spark = targets.sparkSession
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    scale = PERIOD / float(max(1, total))
    t = written(prefix_sums(targets, [], "rank", "slots", "_before"), "mix-intervals")
    low, high = F.col("_before") * scale, (F.col("_before") + F.col("slots")) * scale
    cell = PERIOD // CELLS
    bounds = t.where("slots > 0").select("rank", low.alias("_low"), high.alias("_high"))
    grid = bounds.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_low") / cell), F.floor(F.col("_high") / cell))))
    slots = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % PERIOD) * STEP % PERIOD).alias("_u"))
    hit = slots.withColumn("_cell", F.floor(F.col("_u") / cell)).join(grid, "_cell").where((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
    # Rank of a slot among its source's: chunks of slots are counted, the counts summed.
    hit = written(hit.select("slot", "rank", F.floor(F.col("slot") / CHUNK).alias("_chunk")), "mix-slots")
    counts = hit.groupBy("rank", "_chunk").agg(F.count("*").alias("_n"))
    before = prefix_sums(counts, ["rank"], "_chunk", "_n", "_up").select(F.col("rank").alias("_r"), F.col("_chunk").alias("_c"), "_up")
    inside = F.row_number().over(Window.partitionBy("rank", "_chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("_in", inside).join(before, (F.col("rank") == F.col("_r")) & (F.col("_chunk") == F.col("_c")))
    ranked = ranked.select("slot", "rank", (F.col("_up") + F.col("_in")).alias("k"))
    had = counts.groupBy(F.col("rank").alias("_r")).agg(F.sum("_n").alias("_had"))
    # The few slots by which points fell short of a source's number.
    late = targets.join(had, F.col("rank") == F.col("_r"), "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < slots")
    late = prefix_sums(late.withColumn("_late", F.col("slots") - F.col("_had")), [], "rank", "_late", "_up")
    late = late.select("rank", "_had", "_up", F.explode(F.sequence(F.col("_had"), F.col("slots") - 1)).alias("k"))
    taken = ranked.unionByName(late.select((F.lit(total) + F.col("_up") + F.col("k") - F.col("_had")).cast("long").alias("slot"), "rank", "k"))
    facts = targets.select("rank", "source", "blocks", "slots")
    j = taken.join(F.broadcast(facts) if facts.count() <= FEW else facts, "rank").where("k < slots")
    return j.select("slot", "source", F.floor(F.col("k") / F.col("blocks")).cast("int").alias("epoch"), (F.col("k") % F.col("blocks")).alias("block"))


def shuffled_blocks(rows: DataFrame, seed: int, salts: int) -> DataFrame:
    """Rows of size > 0 cut at the borders of their source's blocks (column block): row, source, size, block, first, words.

    `first` is the offset of the part in its document.
    """
    keyed = rows.where("size > 0").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "key"))
    placed = grouped_prefix(keyed, ["source"], ["_h", "doc_id", "key", "row"], "size", salts, "_start")
    b, start = F.col("block"), F.col("_start")
    last = F.floor((start + F.col("size") - 1) / b)
    parts = placed.withColumn("_at", F.explode(F.sequence(F.floor(start / b), last)))
    lo, hi = F.greatest(start, F.col("_at") * b), F.least(start + F.col("size"), (F.col("_at") + 1) * b)
    return parts.select("row", "source", "size", F.col("_at").alias("block"), (lo - start).alias("first"), (hi - lo).alias("words"))


def mix(docs: DataFrame, block_words: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, parts, schedule) of the mix.

    documents: row, doc_id, source, key (a hash of the text), size, source_size, target;
    parts: a row for each part of a document in a block, with row, source, size, block, first, words;
    schedule: slot, source, epoch, block.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("key"), word_count(F.col("text")).alias("size"))
    rows = written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = written(with_blocks(source_targets(rows), block_words), "mix-shares")
    facts = targets.select(F.col("source").alias("_s"), "source_size", "target", "block")
    facts = F.broadcast(facts) if facts.count() <= FEW else facts
    documents = rows.join(facts, rows["source"].eqNullSafe(F.col("_s"))).drop("_s")
    return documents.drop("block"), shuffled_blocks(documents, seed, max(256, rows.count() // 50_000)), source_schedule(targets)


def mixed_amounts(docs: DataFrame, block_words: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document that the mix takes."""
    documents, parts, schedule = mix(docs, block_words, seed)
    times = schedule.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("_times"))
    used = parts.join(times, parts["source"].eqNullSafe(F.col("_s")) & (parts["block"] == F.col("_b")))
    taken = used.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("words") * F.col("_times")).alias("taken"))
    out = documents.join(taken, documents["row"] == F.col("_row"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 64, seed: int = 7) -> DataFrame:
    """The mix itself: a row for each document and epoch with the words that epoch takes.

    Columns of `docs`; text holds the taken words (the whole text, unchanged, if all are taken),
    n_chars their length. Documents of no words are left out: a mix by words never takes them.
    """
    documents, parts, schedule = mix(docs, block_words, seed)
    s = schedule.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "epoch")
    used = parts.join(s, parts["source"].eqNullSafe(F.col("_s")) & (parts["block"] == F.col("_b")))
    # Taken parts of one epoch: blocks are taken in order, so at most one stretch is cut off.
    spans = used.groupBy(F.col("row").alias("_row"), "epoch").agg(
        F.min("first").alias("first"), F.max(F.col("first") + F.col("words")).alias("end"), F.sum("words").alias("words")
    )
    names = ["doc_id", "source", "key"]
    light = documents.select("row", "size", *names)
    repeated = light.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(n).alias(f"_{n}") for n in names])
    texts = docs.select(fresh(docs).alias("doc"), F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("key"), F.lit(1).alias("copy"))
    light = light.withColumn("copy", F.lit(1))
    if not repeated.isEmpty():
        # Rows of one doc_id, source and text are numbered on both sides.
        same = lambda df: [df[n].eqNullSafe(F.col(f"_{n}")) for n in names]
        known = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
        number = lambda df, order: df.withColumn("copy", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
        both = [(df, number(df.join(repeated, same(df), "left_semi"), order)) for df, order in ((light, ["row"]), (texts, [F.xxhash64(*known)]))]
        light, texts = (df.join(repeated, same(df), "left_anti").unionByName(several) for df, several in both)
    taken = light.join(spans, light["row"] == F.col("_row"))
    t, k = texts.alias("t"), taken.alias("k")
    on = [F.col(f"t.{n}").eqNullSafe(F.col(f"k.{n}")) for n in names] + [F.col("t.copy") == F.col("k.copy")]
    j = t.join(k, on).select("t.doc", F.col("k.first").alias("first"), F.col("k.end").alias("end"), (F.col("k.words") == F.col("k.size")).alias("whole"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), (F.col("first") + 1).cast("int"), (F.col("end") - F.col("first")).cast("int")))
    j = j.withColumn("text", F.when(F.col("whole"), F.col("doc.text")).otherwise(cut))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast("long")
    return j.select(*[v.alias(c) for c, v in columns.items()])
