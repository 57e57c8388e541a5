"""The kept index against a search that reads every text."""

import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import index, kept, retrieval

WORDS = [f"w{i}" for i in range(40)] + ["Thuế", "LAO", "động"]


def corpus(seed, n, rare=0.05):
    """Texts of very different lengths with words of a steep distribution; some are null or empty, some repeat."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([3, 10, 40, 300])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[0][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def asked(spark, *words):
    q = spark.createDataFrame(list(enumerate(words)), "query int, words string")
    return q.select("query", retrieval.query_terms(F.col("words")).alias("terms"))


SEARCHES = ("w0 w1", "thue", "w3 w17 động", "w0 AND nothing", "w2", "lao w5 w0 w0")


def slow(spark, rows, queries, limit, all_terms=True):
    hits = retrieval.bm25(frame(spark, rows).withColumnRenamed("id", "key"), "key", "text", queries, all_terms).withColumn("score", F.round("score", 6))
    return sorted(map(tuple, retrieval.ranked(hits, [F.desc("score"), F.col("key")], limit).select("query", "key", "score", "rank").collect()))


def fast(spark, path, queries, limit, **options):
    return sorted(map(tuple, index.search(spark, path, queries, limit, digits=6, **options).select("query", "key", "score", "rank").collect()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus(1, 900)
    path = str(tmp_path_factory.mktemp("index") / "a")
    return rows, index.build(frame(spark, rows), "id", F.col("text"), path)


@pytest.mark.parametrize("limit, all_terms", [(5, True), (100, True), (7, False), (5000, True)])
def test_lists_equal_those_of_a_whole_read(spark, made, limit, all_terms, monkeypatch):
    monkeypatch.setattr(index, "FIRST", 2)
    rows, path = made
    q = asked(spark, *SEARCHES)
    assert fast(spark, path, q, limit, all_terms=all_terms) == slow(spark, rows, q, limit, all_terms)


def test_filters_count_before_the_limit(spark, made):
    rows, path = made
    q, allowed = asked(spark, *SEARCHES), [(k, t) for k, t in rows if k % 3 == 0]
    got = index.search(spark, path, q, 5, digits=6, allowed=frame(spark, allowed).select("id")).collect()
    every = [r for r in slow(spark, rows, q, 10_000) if r[1] % 3 == 0]
    want = {(s, k, score) for s in {r[0] for r in every} for k, score in sorted(((r[1], r[2]) for r in every if r[0] == s), key=lambda x: (-x[1], x[0]))[:5]}
    assert {(r["query"], r["key"], r["score"]) for r in got} == want


def test_few_postings_are_read(spark, tmp_path, monkeypatch):
    """Texts whose words crowd in few documents: a list of ten needs a small share of the postings."""
    monkeypatch.setattr(index, "BLOCK_BITS", 3)
    rng = random.Random(4)
    rows = [(i, " ".join(["x"] * ((i % 4 == 0) + 40 * (i % 96 == 0)) + ["y"] * rng.randrange(60))) for i in range(4000)]
    path = index.build(frame(spark, rows), "id", F.col("text"), str(tmp_path / "i"))
    seen: dict = {}
    q = asked(spark, "x")
    assert fast(spark, path, q, 10, seen=seen) == slow(spark, rows, q, 10)
    assert seen["postings"] == 1000 and seen["read"] <= 0.25 * seen["postings"]


def test_changes_equal_an_index_made_anew(spark, made, tmp_path):
    rows, _ = made
    path = index.build(frame(spark, rows), "id", F.col("text"), str(tmp_path / "i"))
    rng = random.Random(9)
    changed = [(k, " ".join(rng.choices(WORDS, k=20))) for k in (3, 40, 41, 900)] + [(2000, "Thuế thuế w0 w1 mới"), (2001, None)]
    same = [rows[5], rows[6]]
    gone = [7, 8, 9, 902, 77_777]
    index.update(spark, path, frame(spark, changed + same), "id", F.col("text"), spark.createDataFrame([(k,) for k in gone], "id long"))
    now = {k: t for k, t in rows if k not in gone} | dict(changed)
    assert kept.load(spark, path, [1], "docs").count() == len(changed)  # what didn't change was skipped
    q = asked(spark, *SEARCHES, "mới")
    assert fast(spark, path, q, 30) == slow(spark, list(now.items()), q, 30)
    # A second round of changes, one of them back to the first text; then one generation without the dead.
    index.update(spark, path, frame(spark, [rows[3], (2000, "")]), "id", F.col("text"))
    now |= {rows[3][0]: rows[3][1], 2000: ""}
    want = slow(spark, list(now.items()), q, 30)
    assert fast(spark, path, q, 30) == want
    small = index.compact(spark, path, str(tmp_path / "c"))
    assert kept.generations(spark, small) == [0] and fast(spark, small, q, 30) == want
    live = kept.load(spark, small, [0], "postings").select(F.explode("entries.key").alias("k")).distinct()
    assert {r["k"] for r in live.collect()} == {k for k, t in now.items() if t}


def test_generation_without_its_end_is_not_read(spark, made, tmp_path):
    rows, _ = made
    path = index.build(frame(spark, rows[:50]), "id", F.col("text"), str(tmp_path / "i"))
    kept.save(kept.load(spark, path, [0], "postings"), path, 1, "postings")
    assert kept.generations(spark, path) == [0]
    with pytest.raises(ValueError, match="already"):
        index.build(frame(spark, rows), "id", F.col("text"), path)
    with pytest.raises(ValueError, match="no index"):
        index.search(spark, str(tmp_path / "none"), asked(spark, "x"), 1)


def test_rows_of_one_key_and_empty_tables(spark, tmp_path):
    rows = [(1, "a b"), (1, "a a"), (None, "a"), (2, None)]
    path = index.build(frame(spark, rows), "id", F.col("text"), str(tmp_path / "i"))
    assert [r[1] for r in fast(spark, path, asked(spark, "a"), 5)] == [1] and kept.load(spark, path, [0], "whole").first()["docs"] == 2
    none = index.build(frame(spark, rows).limit(0), "id", F.col("text"), str(tmp_path / "n"))
    assert fast(spark, none, asked(spark, "a"), 5) == []
    index.update(spark, none, frame(spark, [(5, "a")]), "id", F.col("text"))
    assert [r[1] for r in fast(spark, none, asked(spark, "a", "b"), 5)] == [5]


def test_building_shuffles_texts_and_postings_once(spark, tmp_path):
    """What tasks write to shuffles: each text, each posting, counts by term. Blocks that Arrow batches cut are whole."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(1500)]
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    store, jvm, gateway = spark._jsc.sc().statusStore(), spark._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()

    def shuffled():
        stages = store.stageList(none, False, False, gateway.new_array(jvm.double, 0), none).iterator()
        n = 0
        while stages.hasNext():
            n += stages.next().shuffleWriteRecords()
        return n

    before = shuffled()
    path = index.build(docs, "id", F.col("text"), str(tmp_path / "i"))
    made = shuffled() - before
    postings = kept.load(spark, path, [0], "postings")
    assert postings.groupBy("term", "gen", "block").count().where("count > 1").isEmpty()
    assert postings.groupBy("block").agg(F.countDistinct(F.get("entries.key", F.lit(0)))).count() == kept.load(spark, path, [0], "docs").select("block").distinct().count()
    assert made <= len(rows) + postings.count() + 4 * len(words) * 4 + 100
    want = {(k, w, t.split().count(w)) for k, t in rows for w in set(t.split())}
    got = postings.select("term", F.explode("entries").alias("e")).select("e.key", "term", "e.tf").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
