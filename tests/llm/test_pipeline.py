"""The pipeline's stages, each on what the one before kept."""

import numpy as np

import corpus_pipeline
from statuta.llm import common, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = common.table(spark, FOLDER, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, FOLDER), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    n = {k: v.count() for k, v in seen.items()}
    assert n["language"] >= n["near_duplicates"] >= n["repeated_passages"] > 0
    kept = simhash.similar_groups(seen["near_duplicates"])
    assert kept.count() == kept.select("component_id").distinct().count()
    assert seen["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = common.table(spark, FOLDER, "documents")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_planted_copies_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for size in (8, 40, 150, 400):
        for _ in range(6):
            base = [f"w{x}" for x in rng.integers(0, 5000, size)]
            for edits in (0, 0, 1, 2, size // 60, size // 45, size // 35, size // 25):
                words = list(base)
                for at in rng.integers(0, size, edits):
                    words[at] = f"x{rng.integers(0, 10**6)}"
                rows.append((n, " ".join(words)))
                n += 1
    line = " ".join(f"c{x}" for x in range(30))
    rows += [(n + i, f"{line} " + " ".join(f"y{i}x{x}" for x in range(4))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    prints = [simhash.majority([simhash.shingle_hashes(t)]) for _, t in rows]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near(a, b) and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = [new if p == old else p for p in part]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).select("doc_id").collect()}
    assert kept == set(part)
    assert len(kept) < simhash.keep_first(docs).count()
