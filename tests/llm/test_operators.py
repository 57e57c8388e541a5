"""Training-data operators against brute force, on small tables and on awkward rows."""

import collections
import hashlib
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from statuta.llm import attribution, common, epsilon, language, licenses, mixing, packing, queries, scoring, simhash, substrings, tokens, topk

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, 1), (3, "One two three.", "en", "a", 3), (3, "One two three.", "en", "a", 3),
        (3, "other text here", None, "b", 2), (None, long, "en", "b", 1), (4, long, "de", "b", 1), (5, "... 123 ---", "fr", "c", 1), (6, "Café ÉÀ 😀 naïve\n\nxx\n", "fr", None, 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "block", "fp", "key", "node", "length", "part", "label", "score", "_row", "rank", "word", "_key", "_told", "told", "_d", "_k", "_e", "_l", "_s", "_ranges", "ranges",
                 "_new", "new", "_copy", "copy", "doc", "first", "cls", "row", "taken", "epoch", "_h", "_n", "_text", "component_id", "target", "words"):
        df = df.withColumn(name, df["lang"])
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def ascii_words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    r = c.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SMALL).select(*r.columns)
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(str(x) for x in r.fetchall())


# Operator 8


def slow_print(t, n=3):
    w = ascii_words((t or "")) and (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return [top(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, docs):
    got = frame(queries.op8_simhash_vptree(spark, SMALL), "doc_id")
    src = frame(docs, "doc_id")
    prints = [slow_print(t) for t in src["text"]]
    assert list(got["fingerprint"]) == [f"{p:016x}" for p in prints]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert list(got["component_id"]) == [src["doc_id"][k] for k in closure(len(prints), pairs)]


def planted(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64))
    ball = np.repeat(base[:1], 400)
    return np.unique(np.concatenate([base, flip(base[: n // 3]), flip(flip(base[: n // 4])), flip(flip(flip(ball)))]))


def same_parts(x, u, v):
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    a, b = np.nonzero(d <= 2)
    assert (simhash.spanning(len(x), np.searchsorted(x, u), np.searchsorted(x, v)) == simhash.spanning(len(x), a, b)).all()


def test_vantage_tree_loses_no_pair():
    x = planted(1200, 0)
    points, radii = simhash.fit_tree(np.random.default_rng(1).permutation(x)[:500], 4)
    row, leaf, guest = simhash.route(x, np.zeros(len(x), bool), points, radii, 4, 2)
    assert (np.bincount(row[~guest], minlength=len(x)) == 1).all()
    found = [f for k in range(16) for f in simhash.vantage_links(x[row[(leaf == k) & ~guest]], x[row[(leaf == k) & guest]], 2)]
    same_parts(x, *(np.concatenate([f[i] for f in found]) for i in (0, 1)))


@pytest.mark.parametrize("ball", [False, True])
def test_crowded_leaves_are_split_and_lose_no_pair(spark, monkeypatch, ball):
    rng = np.random.default_rng(2)
    spread = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    spread = np.unique(np.concatenate([spread, spread[:300] ^ np.uint64(5)]))
    x = planted(300, 2) if ball else spread  # planted holds 400 words about one, which no vantage point splits well
    used = []
    joined = simhash.shared_neighbours
    monkeypatch.setattr(simhash, "shared_neighbours", lambda c, r: used.append(c.count()) or joined(c, r))
    monkeypatch.setattr(simhash, "CAPACITY", 50 if ball else 200)
    monkeypatch.setattr(simhash, "PER_LEAF", 1 << 20)
    classes = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64))], "first long, fp long")
    e = [(r["u"]["fp"], r["v"]["fp"], r["u"]["first"]) for r in simhash.links(classes).collect()]
    u, v = (np.array([r[i] for r in e], np.int64).view(np.uint64) for i in (0, 1))
    assert [x[r[2]] for r in e] == list(u) and bool(used) == ball
    same_parts(x, u, v)


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == 10
    zero = got[got["fp"] == 0]
    assert len(zero) == 3 and set(zero["component_id"]) == {1}
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    for keep in (simhash.keep_first, simhash.keep_first_similar):
        kept = keep(odd)
        assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 6]
        assert all(r["_key"] == r["lang"] == r["_h"] == r["doc"] for r in kept.collect()) and keep(none).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(e, "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def jobs_of(spark, f):
    """What f returns, and the number of Spark jobs it took."""
    sc, group = spark.sparkContext, f"jobs-{f.__name__}-{id(f)}"
    sc.setJobGroup(group, group)
    try:
        out = f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


def test_components_go_on_from_stars(spark):
    """What is linked already takes no rounds again, and no round takes a job of its own for its count."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 501), (502, 503)], "u long, v long")
    more = spark.createDataFrame([(299, 503), (501, 600)], "u long, v long")
    parts = common.written(common.connected_components(chain, "t"), "t-nodes")
    found = lambda edges: {r["node"]: r["component"] for r in common.connected_components(edges, "t").collect()}
    whole, jobs = jobs_of(spark, lambda: found(chain.unionAll(more)))
    got, fewer = jobs_of(spark, lambda: found(common.joined_to(parts, more)))
    assert got == whole == {**dict.fromkeys([*range(301), 502, 503], 0), 500: 500, 501: 500, 600: 500}
    assert fewer <= 0.75 * jobs, (fewer, jobs)
    none = chain.where("u < 0")
    (n, h), taken = jobs_of(spark, lambda: common._edges_written(none, "t")[1])
    assert (n, h) == (0, None) and found(none) == {} and taken <= 1
    t, (n, h) = common._edges_written(chain, "t")
    from pyspark.sql import functions as F

    assert (n, h) == tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) and n == 302


@pytest.mark.parametrize("hot", [3, 1 << 20])
def test_components_with_a_hub_of_structs(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "HOT", hot)
    e = spark.range(1, 5001).select(F.struct((F.col("id") * 7 % 5003).alias("first"), F.col("id").alias("fp")).alias("u"))
    hub = F.struct(F.lit(2500).cast("long").alias("first"), F.lit(0).cast("long").alias("fp"))
    got = common.connected_components(e.withColumn("v", hub), "t").select("component.first", "node.fp").collect()
    assert len(got) == 5001 and {r["first"] for r in got} == {1}


def test_hot_keys_find_their_facts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("k") * 2).alias("x"))
    for hot in (10, 1 << 20):
        monkeypatch.setattr(common, "HOT", hot)
        got = common.attached(rows, facts, "k", "n")
        assert got.count() == 1000 and got.where("x <> 2 * k").count() == 0 and "n" not in got.columns


def test_prefix_sums_in_stretches(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("at"), (F.col("id") * 7 % 11).alias("n"))
    got = common.prefix_sums(rows, ["g"], "at", "n", "up", span=10).toPandas().sort_values(["g", "at"])
    assert (got["up"] == got.groupby("g")["n"].cumsum() - got["n"]).all()


# Operator 4


def slow_removal(rows, width=13):
    first, out = {}, []
    key = lambda d: common.NO_ID if d is None or d != d else d
    words = [ascii_words(t) for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, common.NO_ID), key(d))
    for (d, _), w in zip(rows, words):
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                keep[i : i + width] = [False] * width
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark, docs):
    got = frame(queries.op4_substring_dedup(spark, SMALL), "doc_id")
    src = frame(docs, "doc_id")
    assert [tuple(r) for r in got[["n_words", "n_removed", "kept_sha256"]].values] == slow_removal(list(zip(src["doc_id"], src["text"])))


def test_substring_odd_rows_and_small_batches(spark, odd, none, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH", 500)
    got = sorted(map(tuple, substrings.digests(odd).select("n_words", "n_removed", "kept_sha256").collect()))
    src = odd.select("doc_id", "text").collect()
    assert got == sorted(slow_removal([tuple(r) for r in src]))
    assert substrings.digests(none).count() == 0 and substrings.cleaned(none).count() == 0
    kept = substrings.cleaned(odd)
    assert kept.columns == odd.columns and all(r["_new"] == r["_d"] == r["_ranges"] == r["lang"] for r in kept.collect())


def test_substring_hot_words_and_passages(spark, monkeypatch):
    """A word of 0.9 % of documents, split minimisers, a passage in every batch, several ids of one number."""
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = []
    for i in range(1200):
        words = [f"w{x}" for x in rng.integers(0, 40, 30)]
        if i % 110 == 0:
            words[10] = "seldom"
        if i % 9 == 0:
            words[5:5] = passage.split()
        rows.append((int(i if i % 50 else 7), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("BATCH", 400), ("HOT_BYTES", 2000), ("HOT_SAMPLE", 2), ("REMEMBERED", 2000), ("STRETCH", 64)):
        monkeypatch.setattr(substrings, name, value)
    frequent = substrings.frequent_words(df)
    assert len(substrings.hot_minimisers(df, 13, frequent)) > 5
    got = sorted(map(tuple, substrings.digests(df).select("n_words", "n_removed", "kept_sha256").collect()))
    assert got == sorted(slow_removal(rows))


def test_split_minimisers_deal_equal_windows_alike():
    rng = np.random.default_rng(1)
    words = [b"a%d" % x for x in rng.integers(0, 9, 60)]
    docs = [words, [b"z", *words[20:50], b"y"]]
    none = np.zeros(0, np.uint64)
    least = np.unique(substrings.super_kmers(docs, 13, none, none)[1])
    strings, bucket, doc, first, n = substrings.super_kmers(docs, 13, none, least)
    of = {}
    for s, b, k in zip(strings, bucket.tolist(), n.tolist()):
        w = s.split()
        for i in range(k):
            of.setdefault(tuple(w[i : i + 13]), set()).add(b)
    assert all(len(b) == 1 for b in of.values()) and len(of) == 48 + 2 and len(np.unique(bucket)) > len(least)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "R", 1)
    monkeypatch.setattr(substrings, "R_INVERSE", 1)  # every permutation of bytes collides now
    data = b"\n".join([b"a b c", b"c b a", b"a b c", b"b a c d"])
    kmer, window = substrings.repeated_windows(data, np.array([1, 2, 3, 4]), 3)
    assert list(zip(kmer.tolist(), window.tolist())) == [(2, 0)]


# Operator 10


def vectors(spark, n=400):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").limit(n).toPandas()
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(e["vec_id"], e["embedding"])]
    rng = np.random.default_rng(3)
    near = [(10_000 + k, [x + float(rng.normal(0, 0.01)) for x in rows[k % 7][1]]) for k in range(60)]
    odd_rows = [(20_000, None), (20_001, []), (20_002, [0.0] * 64), (20_003, [float("nan")] * 64), (20_004, [None] * 64), (20_005, [float("inf")] + [0.0] * 63),
                (20_006, [2 * x for x in rows[0][1]]), (20_007, rows[0][1][:32]), (rows[1][0], rows[1][1]), (None, rows[2][1]), (20_008, [1e-200 * x for x in rows[3][1]])]
    return rows + near + odd_rows


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_epsilon_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(epsilon, "INTERVAL", 64)
    monkeypatch.setattr(epsilon, "LEAF", 32)
    rows = vectors(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", common.F.lit(1)).withColumn("id", common.F.lit(2))
    units = [np.array(v) / np.abs(v).max() if good(v) and np.abs(v).max() > 0 else None for _, v in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    ok = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if ok(units[i], units[j])]
    n = collections.Counter(k for p in linked for k in p)
    label = closure(len(rows), linked)
    members = collections.defaultdict(list)
    for i, k in enumerate(label):
        members[k].append(rows[i][0])
    least = {k: min((x for x in m if x is not None), default=None) for k, m in members.items()}
    want = [(rows[i][0], n[i], least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows))]
    got = [tuple(r) for r in epsilon.near_duplicates(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert epsilon.near_duplicates(df.limit(0)).count() == 0


# Operator 2


def slow_top_k(rows, k=20):
    table = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if good(v)]
    want = []
    for at, (i, q) in enumerate(table):
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for other, (j, v) in enumerate(table) if other != at)[:k]
            want += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(best)]
    return sorted(map(str, want))


@pytest.mark.parametrize("block", [40, 120, 1 << 13])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = [r for r in vectors(spark) if r[1] is None or len(r[1]) in (0, 64)]
    rows += [(20, rows[3][1]), (20, rows[5][1]), (None, rows[1][1]), (40, rows[3][1]), (41, rows[3][1])]  # repeated and null ids, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", common.F.lit("x"))
    assert sorted(str(tuple(r)) for r in topk.top_k(df).collect()) == slow_top_k(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_large_values_and_few_rows(spark):
    rows = [(20 * i, [float((-1) ** i * 3_000_000 * (i + 1)), 5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.top_k(df, k=3).collect()}
    assert len(got) == 12 and got[0, 1] == 64 * 3_000_000 * 64 * 9_000_000 + 320 * 320
    rows = [(20 * i, [2.0**22 + i, 3.0 * i]) for i in range(40)]  # products past 2**53, and past 2**63 below
    assert sorted(str(tuple(r)) for r in topk.top_k(spark.createDataFrame(rows, df.schema), k=3).collect()) == slow_top_k(rows, 3)
    huge = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 2.0]), (2, [-(2.0**40), 2.0]), (3, [0.0, 2.0])], df.schema)
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge).collect()] == [(1, common.NO_ID), (3, 64 * 128), (2, -common.NO_ID - 1)]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_stop_early_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(64 * rng.exponential(1, (3000, 24)) * 0.4 ** np.arange(24) * rng.choice([-1, 1], (3000, 24))).astype(np.int64)
    q, floor = x[:60], np.full(60, -np.inf)
    i, j, share = topk.nra(q, x, 10, np.arange(60), floor)
    assert share < 0.6  # most weight lies in few lists
    score = q @ x.T
    score[np.arange(60), np.arange(60)] = np.iinfo(np.int64).min
    for k in range(60):
        best = np.sort(score[k])[-10]
        assert set(np.flatnonzero(score[k] >= best)) <= set(j[i == k]) and k not in j[i == k]
    again = topk.nra(q, x, 10, np.arange(60), np.sort(score, axis=1)[:, -10].astype(float))
    assert again[2] <= share and set(zip(*again[:2])) >= {(k, c) for k in range(60) for c in np.flatnonzero(score[k] > np.sort(score[k])[-10])}


# Operator 3


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    p = queries.op3_word_backoff_language(spark, folder).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert list(p["held_out"]) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p["doc_id"]]
    held = p[p["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.98 and p["score"].between(0, 1).all()


def test_language_learns_only_from_training_rows(spark, docs):
    train = docs.where(~language.held_out(common.F.col("doc_id")))
    other = docs.withColumn("lang", common.F.when(language.held_out(common.F.col("doc_id")), "xx").otherwise(common.F.col("lang")))
    a, b = (frame(language.predicted(d, "doc_id"), "doc_id") for d in (docs, other))
    pd.testing.assert_frame_equal(a, b)
    assert "xx" not in language.fit(other).languages and set(language.fit(train).languages) == {"de", "en", "es", "fr"}


def test_backoff_is_word_first_then_shorter_grams():
    counts = [(0, "the", 1, 9), (0, "der", 0, 9), (4, "<the", 1, 3), (3, "sch", 0, 5), (1, "e", 1, 4)]
    of = lambda n: tuple(np.array(x, np.int64) for x in ([language.hashes_of(n, [t]).view(np.int64)[0] for k, t, _, _ in counts if k == n], *([c[i] for c in counts if c[0] == n] for i in (2, 3))))
    m = language.Model(["de", "en"], of, {(n, x): 20 for n in (0, 1, 2, 3, 4) for x in (0, 1)})
    assert [p for p, _ in m.predict(["the", "Schule", "e", None, "12 !", "щ"])][:5] == ["en", "de", "en", "und", "und"]
    assert (m.scores(["thez", "the", "schx", "qq"]) == [m.tables[4][1][0], m.scores(["the"])[0], m.tables[3][1][0], [0, 0]]).all()


def slow_language(rows, least=2):
    """Predictions by plain dictionaries, learned from all labelled rows that are not held out."""
    train = [(t, x) for i, t, x in rows if None not in (i, t, x) and zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({x for _, x in train})
    count = {n: {x: collections.Counter() for x in names} for n in (0, 1, 2, 3, 4)}
    cut = lambda w, n: [w] if not n else [(f"<{w}>" if n > 1 else w)[i : i + n] for i in range(len(f"<{w}>" if n > 1 else w) - n + 1)]
    for t, x in train:
        for w in language.WORD.findall(t.lower()):
            for n in count:
                count[n][x].update(cut(w, n))
    known = {n: {g for x in names for g in count[n][x] if sum(count[n][y][g] for y in names) >= least} for n in count}
    out = []
    for _, t, _ in rows:
        words = language.WORD.findall((t or "").lower())
        if not names or not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        log = lambda n, g, x: np.log((count[n][x][g] + 0.5) / (sum(count[n][x].values()) + 0.5 * (len(known[n]) + 1)))
        total = np.zeros(len(names))
        for w in words:
            for n in (0, 4, 3, 2, 1):
                terms = [g for g in cut(w, n) if g in known[n]]
                if terms:
                    total += [np.mean([log(n, g, x) for g in terms]) for x in names]
                    break
        p = np.exp(total - total.max())
        out.append((names[int(np.argmax(total))], p.max() / p.sum()))
    return out


def test_language_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").orderBy("doc_id").limit(120).collect()]
    rows += [(10_001, "shared shared", "en"), (10_002, "shared", None), (10_003, "shared shared", "de"), (10_004, "x" * 90 + " " + "x" * 90, "fr"), (10_005, "x" * 90, None)]
    got = frame(language.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id"), "doc_id")
    want = slow_language(rows)
    assert list(got["lang_pred"]) == [w for w, _ in want] and np.allclose(got["score"], [p for _, p in want])


def test_language_bounds_of_the_sample(spark):
    rows = [(i, f"word{i % 7} text", f"l{i % 30:02}") for i in range(900)]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=12, rows_per_language=10)
    assert len(m.languages) == 12 and all(len(m.tables[n][0]) for n in (0, 1, 2, 3, 4))


def test_language_odd_rows(spark, odd, none):
    got = language.predicted(odd, "doc_id", "text").toPandas()
    assert len(got) == 10 and set(got[got["text"].isin(["", "... 123 ---"]) | got["text"].isna()]["lang_pred"]) == {"und"}
    assert language.predicted(none, "doc_id").count() == 0 and language.identified(odd).columns == odd.columns
    assert all(r["_told"] == r["told"] == r["lang"] for r in language.identified(odd).collect())


# Operator 5


def test_packing_is_whole_and_tight(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = frame(queries.op5_vector_best_fit(spark, SMALL), "sequence_id", "offset")
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got["length"] == got["offset"]).all() and ends.max() <= 1024
    for doc, text in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], np.uint32)
        mine = got[got["doc_id"] == doc].sort_values("piece")
        assert list(mine["piece"]) == list(range(len(mine))) and mine["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"]))
        assert set(mine["length"][1:]) <= {1024}
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 1024) * 1.03 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs_each, cost", [(1024, 1 << 20), (3, 1 << 20), (1024, 300_000)])
def test_plan_keeps_every_constraint(rule, docs_each, cost):
    rng = np.random.default_rng(4)
    counts = {int(k): int(n) for k, n in zip(range(1, 500, 7), rng.integers(1, 60, 72))}
    runs = packing.plan(counts, 1024, docs_each, cost, (1.0, 0.1, 0.1), rule)
    bins = collections.defaultdict(list)
    for length, rank, n, first, offset in runs.tolist():
        for k in range(n):
            bins[first + k].append((offset, length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))]
        assert sum(n for _, n in b) <= 1024 and len(b) <= docs_each and sum(n * n for _, n in b) <= cost
    assert collections.Counter(n for b in bins.values() for _, n in b) == counts


def test_tokens_equal_those_of_the_other_library():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", "Hello  world\n\n x", "it's we'll I'M", "naïve ÉTÉ 12³ ½ ×÷", "日本語 😀 <|endoftext|>", "a b c \t\x0b\x0c\r\n d", "_x__ 1a2 ßẞ ĳ ʼn", " " * 50 + "a", " a", "a  b", "a   b ", "x\n y", "x \ny", "a\u00a0 b", "q" * 99 + " r"]:
        assert tokens.encode_document(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert tokens.byte_lengths()[tokens.encode_document("naïve 日本")].sum() == len("naïve 日本".encode())


def test_tokens_of_texts_made_of_blanks_and_marks():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    parts = np.array([" ", " ", "\n", "\t", "a", "b", "'s", "'", ".", "1", "é", "\u00a0", "\u3000", "\r", "\x1c", "\u0085", "日", "'ll", "<|endoftext|>"])
    for n in rng.integers(0, 10, 4000):
        text = "".join(rng.choice(parts, n))
        assert tokens.encode_document(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_special_strings_are_one_id_in_documents(spark):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  ", "日本 \n<|endoftext|>\n\n y", "<|endoftext| >", ""]
    for text in texts:
        ids = tokens.encode_document(text)
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and ids.dtype == np.uint32
        assert tokens.byte_lengths()[ids].sum() == len(text.encode())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {r["doc_id"]: r["ids"] for r in packing.packed_documents(docs, with_ids=True).collect()}
    assert packed == {i: [*t.encode(x, add_special_tokens=False).ids, packing.END] for i, x in enumerate(texts)}
    counts = {r["doc_id"]: r["n"] for r in attribution.section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert counts == {i: len(n) - 1 for i, n in packed.items()}


def test_vector_rule_decides_placements_at_no_cost(docs):
    """By weights of one size placements differ from those by tokens alone, and sequences are no more; a limit of documents binds."""
    counts = collections.Counter()
    for r in docs.select("text").collect():
        n = len(tokens.encode_document(r["text"])) + 1
        counts[(n - 1) % 1024 + 1] += 1
        counts[1024] += (n - 1) // 1024
    counts = {k: n for k, n in counts.items() if n}
    plans = {w: packing.plan(counts, 1024, 1024, 1 << 20, w, "norm") for w in ((1.0, 0.0, 0.0), packing.WEIGHTS)}
    used = [int((r[:, 3] + r[:, 2]).max()) for r in plans.values()]
    assert used[1] <= used[0] and not np.array_equal(*plans.values())
    few = packing.plan(counts, 1024, 3, 1 << 20, packing.WEIGHTS, "norm")
    assert int((few[:, 3] + few[:, 2]).max()) >= used[1] and not np.array_equal(few, plans[packing.WEIGHTS])


def test_packing_odd_rows(spark, odd, none):
    got = packing.packed_documents(odd).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all() and len(got[(got["start"] == 0)]) == 10
    assert packing.packed_documents(none).count() == 0
    whole = packing.packed_documents(odd, with_ids=True).toPandas()
    assert all(len(i) == n for i, n in zip(whole["ids"], whole["length"]))


# Operator 6


def test_license_base_places_and_suppression(spark):
    rows = [(1, "x UNDER the MIT-License under the mit license. cc by nc cc by nc", None, None, None), (2, "licensed under the GNU General Public License version 2", None, None, None),
            (3, "mit license", None, None, None), (4, "Kapache license version 2 İ", None, None, None)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (15, 4, 1, 12, "cc-by-nc,mit")
    assert got[2]["labels"] == "gpl-2" and got[2]["n_base"] == 0 and got[2]["first_word"] is None
    assert got[3]["labels"] == "mit" and got[3]["base_labels"] == "" and got[4]["n_base"] == 0
    assert len(licenses.signature_rules()) >= 200


def test_every_license_rule_can_fire_alone(spark):
    import re

    for _, _, word, regex, _, _ in licenses.signature_rules():
        must = re.sub(r"\(\?:[^()]*(?:\([^()]*\)\?)?[^()]*\)\??", "", regex)
        assert f" {word} " in must
    names = [(label, " ".join(w.strip("[]").split("|")[0] for w in name.split())) for label, _, ways in licenses.FAMILIES for name in ways]
    rows = [(i, f"It is licensed under the {name.upper()} license") for i, (_, name) in enumerate(names)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(name, got[i]) for i, (_, name) in enumerate(names) if not got[i]]
    assert not missed
    mine = {"expat": "mit", "asl 2 0": "apache-2", "freebsd": "bsd-2-clause", "0bsd": "0bsd", "gplv1": "gpl-1", "gplv2": "gpl-2", "gplv3": "gpl-3", "lgplv2": "lgpl-2", "lgplv2 1": "lgpl-2.1",
            "lgplv3": "lgpl-3", "agplv3": "agpl-3", "psf": "psf", "creative commons zero": "cc0", "gfdl": "gfdl", "odbl": "odbl"}
    assert {name: got[i] for i, (_, name) in enumerate(names) if name in mine} == mine


def test_licenses_odd_rows(spark, odd, none):
    assert licenses.scan(odd).count() == 10 and licenses.scan(none).count() == 0


# Operator 7


def test_mix_meets_targets(spark, docs):
    got = queries.op7_source_mix(spark, SMALL).toPandas().merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert (got["taken"] <= 3 * got["size"]).all()
    g = got.groupby("source").agg({"taken": "sum", "size": "sum", "target": "first", "source_size": "first"})
    assert (g["size"] == g["source_size"]).all() and abs(g["target"].sum() - g["size"].sum()) < 1e-3
    block = np.clip(np.floor(g["target"] / mixing.BLOCKS), 1, 64)
    assert (abs(g["taken"] - g["target"]) <= block / 2 + 1e-6).all()
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(g.index))}
    target, caps, open_ = {}, dict(3 * g["size"]), set(g.index)
    left = float(g["size"].sum())
    while True:  # share, cap, reshare
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > caps[s]}
        if not over:
            break
        for s in over:
            target[s] = caps[s]
        left -= sum(caps[s] for s in over)
        open_ -= over
    target |= {s: left * weights[s] / w for s in open_}
    assert all(abs(target[s] - g["target"][s]) < 1e-6 * max(1, target[s]) for s in g.index)
    again = queries.op7_source_mix(spark, SMALL).toPandas()
    pd.testing.assert_frame_equal(frame_of(got), frame_of(again))


def test_mix_of_small_sources(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(n)), s) for i, (n, s) in enumerate([(10, "a"), (7, "b"), (3, "c"), (400, "d"), (900, "e"), (5000, "f"), (1, None), (0, "g")])]
    got = mixing.mixed_amounts(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    block = np.clip(np.floor(got["target"] / mixing.BLOCKS), 1, 64)
    assert (abs(got["taken"] - got["target"]) <= block / 2 + 1e-6).all() and [got["taken"][k] for k in (0, 1, 2, 7)] == [30, 21, 9, 0]


def test_schedule_keeps_shares_in_every_prefix(spark, docs):
    documents, _, schedule = mixing.mix(docs)
    t = documents.select("source", "source_size", "target").distinct().toPandas().set_index("source")
    s = schedule.toPandas().sort_values("slot")
    share = s["source"].value_counts(normalize=True)
    for n in (50, 200, 1000):
        part = s["source"][:n].value_counts().reindex(share.index).fillna(0)
        assert (abs(part - n * share) <= 4).all()
    assert set(t.index) == set(share.index) and (s.groupby("source")["epoch"].max() < 3).all() and s["slot"].is_unique


def frame_of(df):
    return df[["doc_id", "size", "source_size", "target", "taken"]].sort_values(["doc_id"]).reset_index(drop=True)


def test_mixed_texts_hold_what_is_taken(spark, docs):
    taken = mixing.mixed_amounts(docs).toPandas()["taken"].sum()
    rows = mixing.mixed_documents(docs).toPandas()
    assert sum(len(ascii_words(t)) for t in rows["text"]) == taken and (rows["text"].str.len() == rows["n_chars"]).all()


def test_mix_odd_rows(spark, odd, none):
    got = mixing.mixed_amounts(odd).toPandas()
    assert len(got) == 10 and (got["taken"] <= 3 * got["size"]).all()
    mixed = mixing.mixed_documents(odd)
    assert mixing.mixed_amounts(none).count() == 0 and mixed.columns == odd.columns and mixing.mixed_documents(none).count() == 0
    rows = mixed.collect()
    assert sum(len(ascii_words(r["text"])) for r in rows) == got["taken"].sum() and all(r["_key"] == r["_copy"] == r["lang"] for r in rows)


# Operator 9


def slow_attribution(text, rule):
    ends = np.cumsum(tokens.byte_lengths()[tokens.encode_document(text)]).tolist()
    lines = text.encode().split(b"\n")
    sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
    owner = [k for k, n in enumerate(sizes) for _ in range(n)]
    out, start = [0.0] * len(sizes), 0
    for end in ends:
        c = collections.Counter(owner[start:end])
        if rule == "first":
            out[owner[start]] += 1
        elif rule == "most":
            out[min(c, key=lambda k: (-c[k], k))] += 1
        else:
            for k, n in c.items():
                out[k] += n / (end - start)
        start = end
    return sizes, out


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(spark, docs, rule):
    got = frame(attribution.section_tokens(docs, rule), "doc_id", "section")
    by = dict(tuple(got.groupby("doc_id")))
    for doc, text in docs.select("doc_id", "text").collect():
        sizes, counts = slow_attribution(text, rule)
        assert list(by[doc]["n_bytes"]) == sizes and np.allclose(by[doc]["n_tokens"], counts)


def test_attribution_to_fields(spark):
    rows = [(1, "Hello wor", "ld, again", None), (2, None, None, None), (3, "", "naïve 日", "本 x")]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string, field string")
    for rule in attribution.RULES:
        got = {(r["doc_id"], r["field"]): r for r in attribution.field_tokens(df, ["title", "body", "field"], rule).collect()}
        for doc, *parts in rows:
            whole = "".join(p or "" for p in parts)
            ends = np.cumsum([len((p or "").encode()) for p in parts])
            tokens_, crossing = attribution.allocate(np.cumsum(tokens.byte_lengths()[tokens.encode_document(whole)]), ends, rule)
            assert [got[doc, f]["n_tokens"] for f in ("title", "body", "field")] == list(tokens_) and sum(tokens_) == len(tokens.encode_document(whole))
            assert [got[doc, f]["n_bytes"] for f in ("title", "body", "field")] == [len((p or "").encode()) for p in parts]
    assert got[1, "title"]["n_crossing"] == 1


def test_attribution_odd_rows(spark, odd, none):
    got = attribution.section_tokens(odd).toPandas()
    assert got["n_bytes"].sum() == sum(len((r["text"] or "").encode()) for r in odd.select("text").collect())
    assert attribution.section_tokens(none).count() == 0


# Operator 1


def test_scores_are_log_probabilities(spark, docs):
    token, net, _ = scoring.fit(docs, rounds=1)
    ids = [np.array([3, 700, 12, 12, 1023, 0]), np.array([5])]
    around, target, doc = scoring.windows(ids)
    logs, _ = net.forward(around, target)
    for at in (0, 3, 6):  # probabilities of all tokens in one place sum to 1
        every, _ = net.forward(np.repeat(around[:, [at]], scoring.TOKENS, axis=1), np.arange(scoring.TOKENS))
        assert abs(np.exp(every.astype(np.float64)).sum() - 1) < 1e-3 and np.isclose(every[target[at]], logs[at], atol=1e-4)
    assert list(around[:, 0]) == [scoring.TOKENS, scoring.TOKENS, 700, 12] and list(doc) == [0] * 6 + [1]


def test_training_beats_overall_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    token, net, _ = scoring.fit(docs)
    counts = scoring.corpus_counts(docs)
    assert counts.sum() == sum(len(ascii_words(r["text"])) for r in docs.select("text").collect())
    start = scoring.Network.start(scoring.vocabulary(counts)[1])
    ids = [token[scoring.buckets_of(r["text"])] for r in docs.limit(100).select("text").collect()]
    around, target, _ = scoring.windows(ids)
    assert net.forward(around, target)[0].mean() > start.forward(around, target)[0].mean() + 0.02


def test_gradient_is_that_of_the_score():
    rng = np.random.default_rng(0)
    net = scoring.Network.start(np.ones(scoring.TOKENS))
    around, target = rng.integers(0, scoring.TOKENS + 1, (4, 32)), rng.integers(0, scoring.TOKENS, 32)
    g = net.gradient(around, target).flat
    for j in rng.permutation(np.flatnonzero(g))[:8]:
        up, down = (scoring.Network(net.flat + s * 0.01 * (np.arange(g.size) == j)) for s in (1, -1))
        slope = (up.forward(around, target)[0].astype(np.float64).mean() - down.forward(around, target)[0].astype(np.float64).mean()) / 0.02
        assert abs(slope - g[j]) < 2e-4


def test_registered_training_takes_every_position(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(scoring, "trained", lambda rows, net, share, rate, seed: taken.append((share, seed)) or net)
    queries.op1_masked_likelihood(spark, SMALL)
    assert all(any((p + seed) % share == 0 for share, seed in taken) for p in range(12))


def slow_score(words, token, net, times):
    """Summed log-probabilities of the words by the plain formula, every token's probability written out."""
    ids = [int(token[xxhash.xxh3_64_intdigest(w) % scoring.BUCKETS]) for w in words]
    shared = collections.Counter()
    for w, n in times.items():
        shared[int(token[xxhash.xxh3_64_intdigest(w) % scoring.BUCKETS])] += n
    total = 0.0
    for at, (w, t) in enumerate(zip(words, ids)):
        h = net.bias.astype(np.float64).copy()
        for k, d in enumerate((-2, -1, 1, 2)):
            h += net.embed[k][ids[at + d] if 0 <= at + d < len(ids) else scoring.TOKENS]
        h = np.tanh(h)
        by_group = h @ net.group + net.group_bias
        p = np.exp(by_group - np.logaddexp.reduce(by_group))[t // scoring.EACH]
        inside = (h + net.inner[t // scoring.EACH]) @ net.each + net.each_bias[t // scoring.EACH]
        p *= np.exp(inside - np.logaddexp.reduce(inside))[t % scoring.EACH]
        total += np.log(p * times[w] / shared[t])
    return total


@pytest.mark.parametrize("held", [4, 1 << 16])
def test_scores_equal_brute_force(spark, docs, monkeypatch, held):
    monkeypatch.setattr(scoring, "HELD", held)
    token, net, rows = scoring.fit(docs, rounds=2)
    monkeypatch.setattr(scoring, "fit", lambda *_, **__: (token, net, rows))
    got = scoring.pseudo_likelihood(docs).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: (r["text"] or "").lower().encode().split() for r in docs.select("doc_id", "text").collect()}
    times = collections.Counter(w for t in texts.values() for w in t)
    for doc in sorted(texts)[:25]:
        want = slow_score(texts[doc][:], token, net, times)
        assert got.loc[doc, "n_tokens"] == len(texts[doc]) and np.isclose(got.loc[doc, "log_likelihood"], want, rtol=1e-4)


def test_scores_do_not_depend_on_splits(spark, docs, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD", 1 << 14)
    monkeypatch.setattr(scoring, "FAN", 3)
    a, b = (frame(scoring.pseudo_likelihood(docs.repartition(n)), "doc_id") for n in (1, 7))
    assert np.allclose(a["log_likelihood"], b["log_likelihood"], rtol=1e-6) and len(a) == docs.count()


def test_copies_are_averaged_by_positions(spark, monkeypatch):
    monkeypatch.setattr(scoring, "FAN", 2)
    copies = [(i, i + 1, (np.array([i, 2.0 * i]) * (i + 1)).tobytes()) for i in range(7)]
    mean, weight = scoring.averaged(spark.createDataFrame([(i, w, bytearray(b)) for i, w, b in copies], "shard long, weight long, flat binary"))
    assert weight == 28 and np.allclose(mean, np.array([1, 2]) * sum(i * (i + 1) for i in range(7)) / 28)


def test_scoring_odd_rows(spark, odd, none):
    got = scoring.pseudo_likelihood(odd, rounds=1).toPandas()
    assert len(got) == 10 and (got.loc[got["n_tokens"] == 0, "log_likelihood"] == 0).all() and (got["log_likelihood"] <= 0).all()
    assert scoring.pseudo_likelihood(none, rounds=1).count() == 0


def test_windows_take_few_bytes_a_word():
    """Of a bucket's windows at its peak, and of words that wait for their batch."""
    words = [b"w%05d" % i for i in np.random.default_rng(5).integers(0, 30_000, 100_000)]
    data = b"\n".join(b" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
    tracemalloc.start()
    try:
        substrings.repeated_windows(data, np.arange(2500), 13)
        assert tracemalloc.get_traced_memory()[1] < 150 * len(words)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        held = substrings.read(b" ".join(words).split())
        assert tracemalloc.get_traced_memory()[0] - before < 30 * len(held[1])
    finally:
        tracemalloc.stop()
