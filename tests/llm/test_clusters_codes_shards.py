"""Centroids, codes and shards against brute force, on awkward rows and with a hot group."""

import hashlib
import zlib

import numpy as np
import pytest

from statuta.llm import centroids, codes, sharding

VECTORS = "vec_id long, embedding array<double>, label int"


def made(spark, rows, like=VECTORS):
    """Rows with columns of names that the operators use inside."""
    df = spark.createDataFrame(rows, like)
    for name in ("q", "v", "cluster", "distance", "pos", "part", "weight", "key", "code", "n", "name", "copies", "error", "_h", "_at", "_part", "doc", "shard", "slot", "_index", "size"):
        df = df.withColumn(name, df["label" if "label" in like else "lang"])
    return df


@pytest.fixture(scope="module")
def vectors():
    """Vectors of eight components: tight groups, a vector that a third of the rows has, repeated ids, what isn't kept."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    x = (base[rng.integers(0, 12, 300)] + 0.1 * rng.normal(size=(300, 8))).tolist()
    rows = [(i, v, i % 5) for i, v in enumerate(x)] + [(1000 + i, x[7], None) for i in range(150)]
    rows += [(7, x[8], 1), (7, x[8], 1), (None, x[9], None), (None, x[9], 2)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (2004, [None] * 8, 1), (2005, [0.0] * 8, 1), (2006, [-0.0] * 8, None)]
    return rows


def usable(rows, width=None):
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and (width is None or len(v) == width)
    return [(i, tuple(map(float, v)), label) for i, v, label in rows if fine(v)]


def floors(v, scale):
    return tuple(int(np.floor(scale * x)) for x in v)


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def slow_rounds(points, entries, rounds):
    """Lloyd's rounds by the plain formula."""
    entries = [tuple(e) for e in entries]
    closest = lambda p: min((far(p, e), j) for j, e in enumerate(entries))[::-1]
    for _ in range(rounds):
        own = [closest(p)[0] for p in points]
        groups = [[p for p, o in zip(points, own) if o == j] for j in range(len(entries))]
        entries = [tuple(sum(c) // len(g) for c in zip(*g)) if g else e for g, e in zip(groups, entries)]
    return entries, [closest(p) for p in points]


def slow_clusters(rows, k, rounds, width):
    kept = [(i, floors(v, 64)) for i, v, _ in usable(rows, width)]
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    seeds = [q for i, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    entries, found = slow_rounds([q for _, q in kept], seeds, rounds)
    per = {j: sum(d for c, d in found if c == j) for j, _ in found}
    digest = lambda j: hashlib.sha256(",".join(map(str, entries[j])).encode()).hexdigest()
    return sorted((str(i), c, d, per[c], sum(per.values()), digest(c)) for (i, _), (c, d) in zip(kept, found))


@pytest.mark.parametrize("table", [1 << 20, 64])
def test_clusters_equal_brute_force(spark, vectors, monkeypatch, table):
    monkeypatch.setattr(centroids, "TABLE", table)
    monkeypatch.setattr(centroids, "BLOCK", 2)
    got = centroids.cluster_report(made(spark, vectors).repartition(5), k=16, rounds=3, width=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == slow_clusters(vectors, 16, 3, 8)


def test_partial_distances_find_the_nearest_and_take_less(monkeypatch):
    rng = np.random.default_rng(5)
    middle = rng.integers(-60, 60, (16, 64))
    x = middle[rng.integers(0, 16, 3000)] + rng.integers(-4, 5, (3000, 64))
    middle[3] = middle[9]  # a tie everywhere
    counted: list[int] = []
    number, best = centroids.nearest(x, middle, np.argsort(-x.var(0)), counted)
    d = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    assert sum(counted) < 0.4 * d.size * 64


def test_nearest_takes_whole_numbers_of_any_size():
    x = np.array([[1 << 40, 0], [-(1 << 62), 5]], object)
    number, best = centroids.nearest(x, np.array([[0, 0], [1 << 40, 1]], object), np.array([0, 1]))
    assert list(number) == [1, 0] and list(best) == [1, (1 << 124) + 25]


def test_clusters_of_few_and_no_rows(spark, vectors):
    none = centroids.cluster_report(made(spark, [(1, None, 1)]), width=8)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(3, [1.0] * 8, 0), (None, [0.5] * 8, 0), (3, [0.25] * 8, 1), (4, [1e300] * 8, 1)]
    got = {(r["vec_id"], r["cluster"]): r for r in centroids.cluster_report(made(spark, few), width=8).collect()}
    assert len(got) == 4 and all(r["distance"] == 0 for r in got.values())
    assert max(c for _, c in got) == 3 and (None, 3) in got  # a null id is the last seed


def slow_codes(rows, parts, entries, rounds):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, floors(r[1], 256)))
    width = len(kept[0][1])
    held = [(i, floors(v, 256), label) for i, v, label in kept if len(v) == width]
    size = width // parts
    books, code, error = [], [""] * len(held), [0] * len(held)
    for p in range(parts):
        points = [q[p * size : (p + 1) * size] for _, q, _ in held]
        book, found = slow_rounds(points, points[:entries], rounds)
        books.append(book)
        for at, (c, d) in enumerate(found):
            code[at], error[at] = code[at] + f"{c:02x}", error[at] + d
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    per = {}
    for (_, _, label), e in zip(held, error):
        per[label] = per.get(label, 0) + e
    return sorted((str(i), c, e, per[label], digest) for (i, _, label), c, e in zip(held, code, error))


@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_codes_equal_brute_force(spark, vectors, monkeypatch, hot):
    monkeypatch.setattr("statuta.llm.common.HOT", hot)  # 20: the common vector, its parts and its label are hot keys
    got = codes.code_report(made(spark, vectors).repartition(5), parts=4, entries=16, rounds=2)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == slow_codes(vectors, 4, 16, 2)


def test_parts_are_counted_once(spark, vectors, monkeypatch):
    """What the rounds go over is as large as the number of different parts."""
    seen = []
    was = codes.moved
    monkeypatch.setattr(codes, "moved", lambda distinct, books: seen.append(distinct) or was(distinct, books))
    codes.quantised(made(spark, vectors), parts=4, entries=16)
    rows = [(r["pos"], tuple(r["part"]), r["weight"]) for r in seen[0].collect()]
    kept = [floors(v, 256) for _, v, _ in usable(vectors)]
    assert len(rows) == len({(p, q[2 * p : 2 * p + 2]) for q in kept for p in range(4)}) == len({r[:2] for r in rows})
    assert sum(r[2] for r in rows) == 4 * len(kept) and max(r[2] for r in rows) >= 151


def test_codes_of_odd_widths(spark):
    rows = [(2, [0.5, 1.0, -0.5, 2.0], 1), (3, [1.0], 1), (4, [0.5] * 8, None), (5, [0.0, -1.0, 1.0, 1e300], None)]
    got = {r["vec_id"]: r for r in codes.code_report(made(spark, rows), parts=2).collect()}
    assert got[2]["code"] == "0000" and got[5]["code"] == "0101" and got[2]["error"] == got[5]["error"] == 0
    assert got[3]["code"] is None and got[4]["error"] is None and got[3]["label_error"] == 0
    uneven = codes.code_report(made(spark, rows), parts=3).collect()
    assert len(uneven) == 4 and all(r["code"] is None for r in uneven)
    assert codes.code_report(made(spark, [(1, None, 1)])).count() == 0


# Operator 13

DOCS = "doc_id long, text string, lang string, source string"


def slow_shards(rows, shards, seed=13):
    """(row number, shard, slot): every source's fractional ranks by the plain formula."""
    hashed = lambda x: int(hashlib.md5(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:15], 16)
    key = lambda r: (hashed(r[0]), r[0] is None, r[0] or 0)
    order, at = sorted(range(len(rows)), key=lambda i: key(rows[i])), []
    for s in sorted({r[3] for r in rows}, key=lambda s: (s is None, s or "")):
        own = [i for i in order if rows[i][3] == s]
        at += [((r + (hashed(s) + 0.5) / 2**60) / len(own), s is None, s or "", r, i) for r, i in enumerate(own)]
    out, n = [], len(rows)
    for index, (*_, i) in enumerate(sorted(at)):
        shard = index * shards // n
        out.append((i, shard, index - -(-shard * n // shards)))
    return out


@pytest.fixture(scope="module")
def texts():
    rows = [(i, f"text {i} é" * (i % 7), "en", "big" if i % 3 else f"s{i % 11}") for i in range(500)]
    rows += [(600, None, None, None), (601, "", "de", None), (None, "x", "en", "s1"), (602, "w " * 40_000, "en", "only"), (700, "same", "en", "big"), (700, "same", "en", "big")]
    return rows


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_shards_equal_brute_force(spark, texts, monkeypatch, few):
    monkeypatch.setattr("statuta.llm.common.FEW", few)  # 0: nothing is broadcast
    got = sharding.shard_digests(made(spark, texts, DOCS).repartition(7), shards=8).collect()
    want = []
    for i, shard, slot in slow_shards(texts, 8):
        t = (texts[i][1] or "").encode()
        want.append((texts[i][0], len(t) + 1, zlib.crc32(t), "rows", shard, slot, None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    counts = np.bincount([r["shard"] for r in got], minlength=8)
    assert counts.max() - counts.min() <= 1


def test_every_shard_matches_the_mixture(spark, texts):
    got = sharding.sharded(made(spark, texts, DOCS), shards=8).select("doc.source", "shard").toPandas()
    table = got.groupby(["source", "shard"], dropna=False).size().unstack(fill_value=0)
    share = table.sum(1) / 8
    assert (abs(table.sub(share, axis=0)) <= 2).all().all()


def test_many_sources_of_one_row_are_spread(spark):
    rows = [(i, "t", "en", f"s{i}") for i in range(1000)] + [(1000 + i, "t", "en", "big") for i in range(1000)]
    got = sharding.sharded(made(spark, rows, DOCS), shards=8).select("doc.source", "shard").toPandas()
    big = got[got["source"] == "big"].groupby("shard").size()
    assert len(big) == 8 and abs(big - 125).max() < 30


def test_shards_are_written_whole_and_in_order(spark, texts, tmp_path):
    docs = made(spark, texts, DOCS)  # has a column named shard
    name = sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and set(back.columns) == {*docs.columns, "_shard"}
    assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == sorted(map(str, docs.select("doc_id", "text", "source").collect()))
    want = [texts[i][0] for i, shard, _ in slow_shards(texts, 4) if shard == 2]
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out" / "_shard=2")).collect()] == want


def test_fewer_rows_than_shards(spark):
    rows = [(1, "a", "en", "x"), (2, "b", "en", "y"), (3, None, "en", None)]
    got = sharding.shard_digests(made(spark, rows, DOCS), shards=8).collect()
    assert len({r["shard"] for r in got}) == 3 and all(r["slot"] == 0 for r in got)
    assert sharding.shard_digests(made(spark, rows, DOCS).limit(0)).count() == 0
