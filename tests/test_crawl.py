"""The closure loop against one that takes a document at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from statuta.operators import crawl, graph

REFS, STORE = "source string, target string, number string, relation string", "node string, number string, error string"


def web(seed, n=120, cites=3):
    """Documents that cite others at random, some very often; some aren't there, some can't be read."""
    rng = random.Random(seed)
    refs = [(f"d{i}", f"d{int(n * rng.random() ** 2)}", None, rng.choice(["Căn cứ", "Thay thế", "khác"])) for i in range(n) for _ in range(rng.randrange(2 * cites))]
    refs = [(s, t, "-" if t == "d11" else f"{t[1:]}/2024", r) for s, t, _, r in refs] + [("d3", None, "1/1", "x"), ("d3", "", "1/1", "x"), ("d4", "d9", "other/2024", "x")]
    store = [(f"d{i}", f"{i}/2024", "broken" if i % 17 == 5 else None) for i in range(n) if i % 13 != 7]
    return refs, store, [(f"d{i}", None) for i in range(n - 6, n)]


def slow(refs, store, seeds, budget, batch, hub, nodes=10**9, max_depth=0):
    """The loop, one target at a time."""
    docs, queue = {s: 0 for s, _ in seeds}, {}
    there = {n: (num, e) for n, num, e in store}

    def seed(sources):
        cited = {}
        for s, t, num, r in refs:
            if t and t not in docs and t not in queue and s in docs and queue.get(s, {}).get("state") != "HUB_NOT_EXPANDED":
                cited.setdefault((t, num), []).append((r, docs[s]))
        best = {}
        for (t, num), x in cited.items():
            if any(s in sources for s, tt, _, _ in refs if tt == t) and num.strip() not in crawl.JUNK:
                row = (-len(x), num, min(r for r, _ in x), min(d for _, d in x) + 1)
                if not max_depth or row[3] <= max_depth:
                    best[t] = min(best.get(t, row), row)
        for t, (n, num, r, depth) in best.items():
            p = 3 * graph.WEIGHTS.get(r, graph.OTHER_WEIGHT) + 2 * math.log1p(-n) - 1.5 * depth
            queue[t] = {"number": num, "state": "PENDING", "depth": depth, "priority": p, "attempts": 0}

    seed(set(docs))
    fetched = 0
    while fetched < budget and len(docs) < nodes:
        todo = sorted((t for t in queue if queue[t]["state"] == "PENDING"), key=lambda t: (-round(queue[t]["priority"], 9), queue[t]["depth"], t))[:batch]
        if not todo:
            break
        known, new = set(docs), set()
        for t in todo:
            if fetched == budget:
                return docs, queue, True
            q = queue[t]
            q["attempts"] += 1
            if t not in there or there[t][1]:
                q["state"] = "FAILED"
                continue
            fetched += 1
            degree = sum(num == q["number"] and s in known for s, _, num, _ in refs)
            q["state"] = "HUB_NOT_EXPANDED" if degree > hub else "DONE"
            docs[t] = q["depth"]
            new.add(t)
        seed(new)
    return docs, queue, False


def frames(spark, refs, store, seeds):
    return spark.createDataFrame(refs, REFS), spark.createDataFrame(store, STORE), spark.createDataFrame(seeds, "node string, depth int")


def told(spark, path):
    queue, documents, counts = crawl.state(spark, path)
    return {r["node"]: r["depth"] or 0 for r in documents.collect()}, {r["target"]: (r["state"], r["depth"], r["attempts"], r["number"]) for r in queue.collect()}, counts


def test_loop_equals_one_document_at_a_time(spark, tmp_path):
    refs, store, seeds = web(1)
    r, s, d = frames(spark, refs, store, seeds)
    path = crawl.start(str(tmp_path / "c"), d, r)
    steps = []
    done = crawl.run(spark, path, r, s, budget=40, batch=25, hub=1, on_documents=lambda df: steps.append(sorted(x["node"] for x in df.collect())))
    assert sum(map(len, steps)) == done["fetched"] == len({n for step in steps for n in step})
    docs, queue, _ = slow(refs, store, seeds, 40, 25, 1)
    got_docs, got_queue, counts = told(spark, path)
    # A budget that ends in the middle of a round: the slow loop stops there without queueing what the round found.
    assert got_docs == docs and {t: v[0] for t, v in got_queue.items()} == {t: q["state"] for t, q in queue.items()}
    assert done["fetched"] == 40 and done["stopped"] == "budget" and {v[0] for v in got_queue.values()} >= {"FAILED", "DONE", "PENDING"}
    rest = crawl.run(spark, path, r, s, budget=10_000, batch=25, hub=1)
    docs, queue, _ = slow(refs, store, seeds, 10_000, 25, 1)
    got_docs, got_queue, counts = told(spark, path)
    assert got_docs == docs and {t: v[:3] for t, v in got_queue.items()} == {t: (q["state"], q["depth"], q["attempts"]) for t, q in queue.items()}
    assert rest["stopped"] == "queue empty" and rest["pending"] == 0 and counts["fetched"] == len(docs) - len(seeds)
    assert {v[0] for v in got_queue.values()} == {"FAILED", "HUB_NOT_EXPANDED", "DONE"}
    assert "d11" not in got_queue  # a number that says nothing


@pytest.mark.parametrize("half", [17])
def test_two_halves_equal_one_whole(spark, tmp_path, half):
    refs, store, seeds = web(2)
    r, s, d = frames(spark, refs, store, seeds)
    a, b = (crawl.start(str(tmp_path / x), d, r) for x in "ab")
    crawl.run(spark, a, r, s, budget=2 * half, batch=12, hub=8)
    for _ in range(2):
        crawl.run(spark, b, r, s, budget=half, batch=12, hub=8)
    assert told(spark, a) == told(spark, b)


def test_caps_and_retries(spark, tmp_path):
    refs, store, seeds = web(3)
    r, s, d = frames(spark, refs, store, seeds)
    path = crawl.start(str(tmp_path / "c"), d, r, max_depth=1)
    done = crawl.run(spark, path, r, s, budget=1000, batch=5, hub=1000, nodes=12, max_depth=1)
    docs, _, counts = told(spark, path)
    assert done["stopped"] == "node cap" and 12 <= len(docs) < 17 and max(docs.values()) == 1
    crawl.run(spark, path, r, s, budget=1000, batch=50, hub=1000, max_depth=1)
    _, before, _ = told(spark, path)
    failed = {t for t, v in before.items() if v[0] == "FAILED"}
    assert failed and crawl.retry(spark, path, attempts=2) == len(failed)
    mended = spark.createDataFrame([(f"d{i}", f"{i}/2024", None) for i in range(120)], STORE)
    assert crawl.run(spark, path, r, mended, budget=1000, batch=50, hub=1000, max_depth=1)["fetched"] == len(failed)
    _, after, _ = told(spark, path)
    assert {after[t][0] for t in failed} == {"DONE"} and {after[t][2] for t in failed} == {2} and crawl.retry(spark, path) == 0
    with pytest.raises(ValueError, match="already"):
        crawl.start(path, d, r)
