"""SimHash near-duplicates: vantage-point shards of fingerprints, joined exactly within 2 bits.

A fingerprint bit is 1 if over half of the document's shingle hashes (XXH64, seed 42) set it.
Equal fingerprints are one class. A vantage-point tree, fitted on a bounded sample of classes,
deals the classes over leaves: a node sends what lies within its radius left, the rest right.
By the triangle inequality a pair within r bits can only be parted at a node if the left one's
distance exceeds radius - r; such left ones also visit the right side as guests, so every pair
meets in the leaf of its right-hand member. Crowded leaves are split by further vantage points,
again and again, each leaf by its own rows. Leaves that no vantage point splits (balls of near
copies) go another exact way: two fingerprints are within 2 bits just if they share one of the
65 words within 1 bit. Leaves return spanning links, not pairs; components come from links by
stars, whose nodes carry their smallest doc_id along.

Near copies that share at least 4/5 of their five-word shingles can be up to 20 bits apart, where
no triangle bound prunes. keep_first_similar finds those exactly, too: two sets of that Jaccard
similarity share a shingle among the first n - ceil(4n/5) + 1 of each in any one order, so sets meet
by these shingles (commonest last). A pair whose first common shingle comes too late, or whose parities (bits
that flip with every shingle of a residue) differ in more places than similar sets can, goes while they meet; the
others are compared whole.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null doc_id is
larger than all ids (null if a component has no other). Repeated rows stay rows of one class.
Ties: of equal fingerprints and of rows that repeat a doc_id all are returned; where one row of a
component stays, rows of its smallest doc_id are told apart by a hash of all their columns. Long
texts are hashed in stretches of 16,384 shingles. Empty tables give empty results. Columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, VariantType
from pyspark.sql.window import Window

from statuta.llm.common import NO_ID, attached, collected, connected_components, dropped, fresh, give_back, joined_to, small, small_table, written, written_by_batches

#: Classes that fit the tree; leaves of the tree; rows of a leaf that are joined in one task.
SAMPLE, MAX_LEAVES, CAPACITY = 1 << 18, 1 << 16, 1 << 15
#: Classes that a leaf is meant to own, rows at which a branch is compared outright, levels of a further split.
PER_LEAF, SMALL, LEVELS = 512, 192, 3


def grams_of(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles, in stretches; fewer words than a shingle are one, none have none."""
    if words and len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    for at in range(0, len(words) - shingle + 1, 1 << 14):
        part = words[at : at + (1 << 14) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        yield np.fromiter(map(_hash, grams), np.uint64)


def _hash(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram, 42)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words split at ASCII blanks."""
    return (text or "").encode().lower().split()


def majority(stretches: list[np.ndarray]) -> int:
    """Unsigned 64-bit fingerprint of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in stretches:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    return majority(list(grams_of(words_of(text), shingle)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], np.uint64).view(np.int64))

    return docs.select("doc_id", F.pandas_udf(compute, LongType())("text").alias("fp"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree, in heap order."""
    size = (1 << depth) - 1
    points, radii = np.zeros(size, np.uint64), np.full(size, 64, np.int64)
    held = {0: sample}
    for node in range(size):
        mine = held.pop(node)
        if len(mine):
            points[node] = mine[0]
            d = distance(mine, mine[0]).astype(np.int64)
            radii[node] = np.median(d)
        inside = distance(mine, points[node]) <= radii[node]
        held[2 * node + 1], held[2 * node + 2] = mine[inside], mine[~inside]
        if node >= size // 2:
            del held[2 * node + 1], held[2 * node + 2]
    return points, radii


def route(fp: np.ndarray, guest: np.ndarray, points: np.ndarray, radii: np.ndarray, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, guest): each resident once in its leaf, and as guest where pairs may cross; guests only as such."""
    row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for _ in range(depth):
        d, mu = distance(fp[row], points[node]).astype(np.int64), radii[node]
        left = np.where(guest, d <= mu + reach, d <= mu)
        right = np.where(guest, d > mu - reach, d > mu)
        visit = ~guest & left & (d > mu - reach)
        row = np.concatenate([row[left], row[right], row[visit]])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[visit] + 2])
        guest = np.concatenate([guest[left], guest[right], np.ones(int(visit.sum()), bool)])
    return row, node - ((1 << depth) - 1), guest


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node it reaches over links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def vantage_links(home: np.ndarray, guests: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links (a, b) of all pairs within reach: home with home and home with guests."""
    if not len(home) or len(home) + len(guests) < 2:
        return
    if len(home) + len(guests) > SMALL:
        d, g = distance(home, home[len(home) // 2]).astype(np.int64), distance(guests, home[len(home) // 2]).astype(np.int64)
        mu = int(np.median(d))
        inside, crossing = d <= mu, (d <= mu) & (d > mu - reach)
        right_guests = np.concatenate([guests[g > mu - reach], home[crossing]])
        if max(inside.sum(), (~inside).sum() + crossing.sum()) < 0.9 * len(home):
            yield from vantage_links(home[inside], guests[g <= mu + reach], reach)
            yield from vantage_links(home[~inside], right_guests, reach)
            return
    both = np.concatenate([home, guests])
    for at in range(0, len(home), 256):
        part = home[at : at + 256]
        a, b = np.nonzero(distance(part[:, None], both[None, :]) <= reach)
        keep = b > a + at
        a, b = a[keep] + at, b[keep]
        label = spanning(len(both), a, b)
        linked = np.flatnonzero(label != np.arange(len(both)))
        if len(linked):
            yield both[linked], both[label[linked]]


LINK = "u struct<first:long,fp:long>, v struct<first:long,fp:long>"


def links(classes: DataFrame, reach: int = 2) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints (fp, with `first`) at most `reach` bits apart."""
    n = classes.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / PER_LEAF)))), MAX_LEAVES.bit_length() - 1))
    one_in = max(1, n // SAMPLE)
    drawn = classes.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).select("fp").limit(2 * SAMPLE).toPandas()["fp"]
    sample = np.sort(drawn.to_numpy(np.int64).view(np.uint64))
    points, radii = fit_tree(np.random.default_rng(1).permutation(sample), depth)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            row, leaf, guest = route(fp.view(np.uint64), np.zeros(len(fp), bool), points, radii, depth, reach)
            yield pd.DataFrame({"leaf": leaf, "fp": fp[row], "first": f["first"].to_numpy(np.int64)[row], "guest": guest})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("fp")
        fp, guest, first = f["fp"].to_numpy(np.int64), f["guest"].to_numpy(bool), f["first"].to_numpy(np.int64)
        whole = fp.view(np.uint64)
        found = list(vantage_links(whole[~guest], whole[guest], reach))
        ends = [np.concatenate([x[i] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
        facts = [first[np.searchsorted(fp, e)] for e in ends]
        return pd.DataFrame({"u": _structs(facts[0], ends[0]), "v": _structs(facts[1], ends[1])})

    kind = "leaf long, fp long, first long, guest boolean"
    held = written(classes.select("fp", "first").mapInPandas(deal, kind), "simhash-leaves")
    out, step = None, 0
    while held is not None:
        sizes = held.groupBy("leaf").agg(F.count("*").alias("_n"))
        # Crowded leaves are at most one in CAPACITY of the rows.
        crowded = F.broadcast(written(sizes.where(F.col("_n") > CAPACITY).select("leaf"), "simhash-crowded"))
        ready = held.join(crowded, "leaf", "left_anti").groupBy("leaf").applyInPandas(join, LINK)
        out = ready if out is None else out.unionAll(ready)
        if crowded.isEmpty():
            break
        dealt = written(split_leaves(held.join(crowded, "leaf"), reach, step), "simhash-split")
        balls = dealt.where("ball").select("fp", "first").distinct()
        if not balls.isEmpty():
            out = out.unionAll(shared_neighbours(balls, reach))
        held, step = dealt.where("NOT ball").drop("ball"), step + 1
    return out


def _structs(first: np.ndarray, fp: np.ndarray) -> pd.Series:
    return pd.Series([{"first": a, "fp": b} for a, b in zip(first.tolist(), fp.tolist())], dtype=object)


def split_leaves(crowded: DataFrame, reach: int, step: int) -> DataFrame:
    """The rows of each crowded leaf dealt over 2**LEVELS leaves by vantage points from its own rows.

    ball marks the rows of a leaf that this doesn't split: its largest part still has nine tenths of its rows.
    """

    def split(f: pd.DataFrame) -> pd.DataFrame:
        fp, guest = f["fp"].to_numpy(np.int64), f["guest"].to_numpy(bool)
        home = np.sort(fp[~guest].view(np.uint64))
        if len(home) < 2:
            return f[["leaf", "fp", "first", "guest"]].assign(ball=True)
        sample = np.random.default_rng(step + 2).permutation(home)[: 1 << 12]
        points, radii = fit_tree(sample, LEVELS)
        row, leaf, late = route(fp.view(np.uint64), guest, points, radii, LEVELS, reach)
        if np.bincount(leaf).max() > 0.9 * len(f):
            return f[["leaf", "fp", "first", "guest"]].assign(ball=True)
        at = f["leaf"].to_numpy(np.int64)[row]
        return pd.DataFrame({"leaf": at * (1 << LEVELS) + leaf, "fp": fp[row], "first": f["first"].to_numpy(np.int64)[row], "guest": late, "ball": False})

    return crowded.groupBy("leaf").applyInPandas(split, "leaf long, fp long, first long, guest boolean, ball boolean")


def shared_neighbours(classes: DataFrame, reach: int) -> DataFrame:
    """Spanning links of all pairs at most 2 bits apart, by the words within 1 bit of each."""
    if reach != 2:
        raise ValueError("balls are joined exactly at a reach of 2 bits")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)])
    node = F.struct("first", "fp")
    near = classes.select(node.alias("u"), "fp", F.explode(flips).alias("_m")).select("u", F.col("fp").bitwiseXOR(F.col("_m")).alias("_word"))
    low = near.groupBy("_word").agg(F.min("u").alias("v"))
    return near.join(low, "_word").where("u <> v").select("u", "v").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    prints = written_by_batches(fingerprints(docs, shingle), "simhash-prints")
    first = F.coalesce(F.min("doc_id"), F.lit(NO_ID)).cast("long")
    classes = written(prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("copies")), "simhash-classes")
    parts = connected_components(links(classes, reach), "simhash-links")
    named = classes.join(parts, F.struct("first", "fp") == F.col("node"), "left")
    named = written(named.select("fp", F.nullif(F.coalesce("component.first", "first"), F.lit(NO_ID)).alias("component_id"), "copies"), "simhash-named")
    return attached(prints, named, "fp", "copies").select("doc_id", "fp", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """One row of each component: one of the smallest doc_id. Columns of docs."""
    found = near_duplicates(docs, shingle, reach)
    return first_of(docs, written(found.select("doc_id", "component_id"), "simhash-kept"))


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each component of groups (doc_id, component_id), one of its smallest doc_id."""
    late = small_table(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d")).distinct(), "simhash-late")
    rows = docs.select(fresh(docs).alias("doc"))
    out = rows.join(late, F.col("doc.doc_id").eqNullSafe(F.col("_d")), "left_anti")
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_d"))
    if not repeated.isEmpty():
        # Of rows that repeat a doc_id one of the smallest hash stays; rows of one hash are equal.
        known = [F.col(f"doc.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
        repeated, same = small_table(repeated, "simhash-repeated"), F.col("doc.doc_id").eqNullSafe(F.col("_d"))
        single = out.join(repeated, same, "left_anti")
        several = out.join(repeated, same, "left_semi").select("doc", F.col("doc.doc_id").alias("_d"), F.xxhash64(*known).alias("_h"))
        best = several.groupBy("_d").agg(F.min("_h").alias("_least")).withColumnRenamed("_d", "_e")
        chosen = several.join(best, F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_h") == F.col("_least")))
        out = single.unionAll(chosen.dropDuplicates(["_d"]).select("doc"))
    return out.select("doc.*")


#: Similarity of near copies as a fraction; words of a shingle; sampled documents and shingles whose order they set.
SIMILAR, WORDS, ORDERED, COMMON = (4, 5), 5, 4096, 1 << 16
#: Words of 64 bits that a set's few parities take; rounds in which of a class's pairs only the nearest is compared.
PARITIES, ROUNDS = 8, 1
#: Classes of one size that make a shingle a crowded one; neighbours that a class meets there in a round.
CROWD, NEIGHBOURS = 16, 4


#: Odd multipliers that make one number of the hashes of a shingle's words.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of the five-word shingles of a text, made of those of its words; fewer words are one shingle."""
    words = words_of(text)
    if words and len(words) < WORDS:
        words = [b" ".join(words)] + [b""] * (WORDS - 1)
    if not words:
        return np.zeros(0, np.uint64)
    h, n = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), len(words) - WORDS + 1
    x = sum(h[k : k + n] * f for k, f in enumerate(FACTORS))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # spreads every bit over all
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(shingle_hashes(text))


class Order:
    """The order in which all sets are read: unknown shingles by value, then common ones, commonest last."""

    def __init__(self, common: np.ndarray) -> None:
        self.place = np.argsort(common, kind="stable")
        self.known = common[self.place]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Sorted shingles in this order."""
        if not len(self.known) or not len(x):
            return x
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        there = self.known[at] == x
        last = x[there][np.argsort(self.place[at[there]], kind="stable")]
        return np.concatenate([x[~there], last])


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that several of a bounded sample of documents have, rarest first (at most COMMON)."""
    one_in = max(1, docs.count() // ORDERED)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(shingles, f["text"])]), return_counts=True)
            yield pd.DataFrame({"s": s.view(np.int64), "n": n})

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInPandas(count, "s long, n long")
    top = drawn.groupBy("s").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.col("n").desc(), "s").limit(COMMON).toPandas()
    return top["s"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def class_of(x: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh3_64_intdigest(x.tobytes(), 7)


def parities(x: np.ndarray, width: int) -> np.ndarray:
    """For each of `width` residues (a power of two) whether an odd number of a set's shingles has it, as bytes.

    Two sets' parities differ in as many places at most as there are shingles that only one of them has. Those of half
    the width are the two halves' differences.
    """
    odd = np.bincount((x & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8))


def wide(n: int) -> int:
    """Parities that tell sets of n shingles apart."""
    return max(64 * PARITIES, 1 << (n - 1).bit_length()) if n else 64 * PARITIES


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Parities (bytes) at a smaller width."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def shingled(docs: DataFrame, order: Order) -> DataFrame:
    """doc_id, fp, cls (hash of the set of shingles), n (its size), head (its first shingles), bits and wide (parities, few and as many as
    tell sets of this size apart) of every row."""

    def compute(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            rows = []
            for t in s:
                grams = shingle_hashes(t)
                x = np.unique(grams)
                first = len(x) - -(-SIMILAR[0] * len(x) // SIMILAR[1]) + 1 if len(x) else 0
                rows.append((majority([grams]), class_of(x), len(x), order(x)[:first].view(np.int64), parities(x, 64 * PARITIES).view(np.int64), parities(x, wide(len(x))).tobytes()))
            out = pd.DataFrame(rows, columns=["fp", "cls", "n", "head", "bits", "wide"])
            for c in ("fp", "cls"):
                out[c] = np.array(out[c].tolist(), np.uint64).view(np.int64)
            yield out
        give_back()

    one = F.pandas_udf(compute, "fp long, cls long, n int, head array<long>, bits array<long>, wide binary")
    return docs.select("doc_id", one("text").alias("s")).select("doc_id", "s.*")


def may_be_similar(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles can be similar whose first common shingle is number i of one and j of the other.

    They share what follows at most, and have to share 4/9 of both sizes together.
    """
    top, below = SIMILAR
    return ((n - i) * (top + below) >= (n + m) * top) & ((m - j) * (top + below) >= (n + m) * top)


def parities_apart(x: Column, y: Column) -> Column:
    """In how many places parities differ."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, PARITIES)), F.bit_count(x[0].bitwiseXOR(y[0])))


def sets_of(asked: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, set) of the asked classes (a written table), from the texts of their smallest doc_ids."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = [shingles(t) for t in f["text"]]
            yield pd.DataFrame({"cls": np.array([class_of(s) for s in x], np.uint64).view(np.int64), "set": [s.tobytes() for s in x]})
        give_back()

    wanted = names.join(asked, "cls").select(F.col("cls").alias("_cls"), F.nullif("first", F.lit(NO_ID)).alias("_d"))
    wanted = small_table(wanted.select("_d").distinct(), "simhash-wanted")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    sets = texts.select("text").mapInPandas(whole, "cls long, set binary").join(small(asked), "cls", "left_semi")
    sets = written_by_batches(sets, "simhash-sets")
    return sets if sets.count() <= asked.count() else sets.dropDuplicates(["cls"])  # rows may repeat a doc_id and a set


def verified(pairs: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes (a written table) whose whole sets are similar enough."""
    asked = written(pairs.select(F.col("u").alias("cls")).unionAll(pairs.select(F.col("v").alias("cls"))).distinct(), "simhash-asked")
    sets = sets_of(asked, names, docs)

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = ([np.frombuffer(b, np.uint64) for b in s] for s in (x, y))
        both = (len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(u, v))
        top, below = SIMILAR
        return pd.Series([i * (top + below) >= top * (len(p) + len(q)) for i, p, q in zip(both, u, v)], dtype=bool)

    a, b = (sets.select(F.col("cls").alias(x), F.col("set").alias(f"_{x}")) for x in "uv")
    found = written_by_batches(pairs.join(a, "u").join(b, "v").where(similar("_u", "_v")).select("u", "v"), "simhash-similar")
    dropped(asked, sets)
    return found


def steps(n: Column) -> Column:
    """Steps of sizes: sets of more than one step's difference aren't similar."""
    return F.floor(F.log(n.cast("double")) / float(np.log(SIMILAR[1] / SIMILAR[0])) + 1e-9).cast("int")


def in_several_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(s, cls, n, i, part): rows (s, cls, n, i) of shingles that classes of several components have; part names the component."""
    rows = rows.join(parts, F.col("cls") == F.col("node"), "left").select("s", "cls", "n", "i", F.coalesce("component", "cls").alias("part"))
    ends = [f("part").over(Window.partitionBy("s")) for f in (F.min, F.max)]
    return rows.withColumn("_a", ends[0]).withColumn("_b", ends[1]).where("_a <> _b").drop("_a", "_b")


def by_size(shared: DataFrame) -> DataFrame:
    """(s, step, less, cls, n, i, part): classes that have a partner of a fitting size and another component.

    The larger set of a pair (less: 0) meets smaller ones (1) by a shingle and a step of sizes: similar sets are at most one step
    apart, so the sets of a frequent shingle are dealt by size. Of the smaller set only the first ninth of shingles counts.
    """
    top, below = SIMILAR
    rows = shared.withColumn("step", steps(F.col("n")))
    first = rows.where(F.col("i") * (top + below) <= F.col("n") * (below - top))
    names = ["cls", "n", "i", "part"]
    both = rows.select("s", "step", F.lit(0).alias("less"), *names).unionAll(first.select("s", F.explode(F.array("step", F.col("step") + 1)).alias("step"), F.lit(1).alias("less"), *names))
    other = [f(F.when(F.col("less") == k, F.col("part"))).over(Window.partitionBy("s", "step")) for k in (0, 1) for f in (F.min, F.max)]
    both = both.withColumns({f"_{k}": c for k, c in enumerate(other)})
    met = lambda lo, hi: F.coalesce((F.col(lo) != F.col("part")) | (F.col(hi) != F.col("part")), F.lit(False))
    return both.where(F.when(F.col("less") == 0, met("_2", "_3")).otherwise(met("_0", "_1"))).drop("_0", "_1", "_2", "_3")


def neighbours(shared: DataFrame, bits: DataFrame, seed: int) -> DataFrame:
    """(u, v, apart): pairs of classes in different components that stand next to each other in a crowded shingle.

    The classes of a step of sizes that share a shingle are put in an order drawn by a hash, another one for every
    shingle and round; each meets the few before it. In a group of near copies most find one, so that the group is one
    component before all pairs are looked for.
    """
    top, below = SIMILAR
    group = Window.partitionBy("s", "step")
    rows = shared.withColumn("step", steps(F.col("n"))).withColumn("_c", F.count("*").over(group)).where(F.col("_c") >= CROWD).drop("_c")
    order = group.orderBy(F.xxhash64(F.lit(seed), "s", "cls"), "cls")
    rows = rows.join(bits, "cls").withColumn("_h", F.struct("cls", "n", "part", "bits"))
    rows = rows.withColumn("_o", F.array(*[F.lag("_h", k).over(order) for k in range(1, NEIGHBOURS + 1)]))
    apart = lambda o: parities_apart(F.col("bits"), o["bits"])
    fits = F.filter("_o", lambda o: o.isNotNull() & (o["part"] != F.col("part")) & (apart(o) * (top + below) <= (F.col("n") + o["n"]) * (below - top)))
    best = F.array_min(F.transform(fits, lambda o: F.struct(apart(o).alias("apart"), o["cls"].alias("other"))))
    near = rows.withColumn("_b", best).where("_b IS NOT NULL").select("cls", "_b.other", "_b.apart")
    return near.select(F.least("cls", "other").alias("u"), F.greatest("cls", "other").alias("v"), "apart").distinct()


def candidates(sized: DataFrame, bits: DataFrame) -> DataFrame:
    """(u, v, apart): pairs of classes in different components that may be similar, by what they share and by their parities."""
    top, below = SIMILAR
    rows = sized.join(bits, "cls")
    x = rows.where("less = 0").drop("less").alias("x")
    y = rows.where("less = 1").select("s", "step", *[F.col(c).alias(f"_{c}") for c in ("cls", "n", "i", "part", "bits")]).alias("y")
    n, m = F.col("n"), F.col("_n")
    on = [F.col("part") != F.col("_part"), (n > m) | ((n == m) & (F.col("cls") != F.col("_cls"))), may_be_similar(n, F.col("i"), m, F.col("_i")), parities_apart(F.col("bits"), F.col("_bits")) * (top + below) <= (n + m) * (below - top)]
    both = x.join(y, [F.col("x.s") == F.col("y.s"), F.col("x.step") == F.col("y.step"), *on])
    pairs = both.select(F.least("cls", "_cls").alias("u"), F.greatest("cls", "_cls").alias("v"), parities_apart(F.col("bits"), F.col("_bits")).alias("apart"))
    return pairs.distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) that all parities of their sets (cls, n, wide) allow, with how far these are apart."""
    top, below = SIMILAR

    @F.pandas_udf("int")
    def differences(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            size = min(len(p), len(q))
            out.append(int(np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()))
        return pd.Series(out, dtype="int32")

    a, b = (classes.select(F.col("cls").alias(x), F.struct("n", "wide").alias(f"_{x}")) for x in "uv")
    both = pairs.select("u", "v").join(a, "u").join(b, "v").withColumn("apart", differences("_u.wide", "_v.wide"))
    return both.where(F.col("apart") * (top + below) <= (F.col("_u.n") + F.col("_v.n")) * (below - top)).select("u", "v", "apart")


def nearest_partners(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs that are the nearest of one of their ends, by parities."""
    both = pairs.select(F.col("u").alias("cls"), "u", "v", "apart").unionAll(pairs.select(F.col("v").alias("cls"), "u", "v", "apart"))
    return both.groupBy("cls").agg(F.min_by(F.struct("u", "v"), F.struct("apart", "u", "v")).alias("p")).select("p.*").distinct()


def similar_links(classes: DataFrame, links: DataFrame, names: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Edges of the components of links and of further links of classes (cls, n, head, bits, wide) that are similar enough.

    First classes meet their neighbours in crowded shingles, which joins large groups of near copies. Then all classes
    of different components meet that share a first shingle and may be similar. Of these pairs first only the nearest of
    each class is compared; last, all that aren't in one component yet: none is left out. What is linked so far
    goes on as stars.
    """
    spark, bits = docs.sparkSession, classes.select("cls", "bits")
    known = lambda: small_table(connected_components(links, "simhash-rounds"), "simhash-nodes")
    parts = known()
    shared = written(in_several_parts(classes.select("cls", "n", F.posexplode("head").alias("i", "s")), parts), "simhash-shared")
    for k in range(rounds):
        collected(spark)
        near = written(nearest_partners(neighbours(shared, bits, k)), "simhash-near")
        links = joined_to(parts, verified(near, names, docs))
        parts = known()
        rest = written(in_several_parts(shared.drop("part"), parts), "simhash-shared")
        dropped(near, shared)
        shared = rest
    collected(spark)
    sized = written(by_size(shared), "simhash-sized")
    dropped(shared)
    collected(spark)
    met = written(candidates(sized, bits), "simhash-candidates")
    ends = small_table(met.select(F.col("u").alias("cls")).unionAll(met.select(F.col("v").alias("cls"))).distinct(), "simhash-ends")
    pairs = written(likely(met, written(classes.join(ends, "cls", "left_semi").select("cls", "n", "wide"), "simhash-wide")), "simhash-likely")
    dropped(sized, met)
    for k in range(rounds + 1):
        collected(spark)
        of = lambda x, y: parts.select(F.col("node").alias(f"_{x}"), F.col("component").alias(y))
        parts = known() if k else parts
        a, b = (of(x, f"_p{x}") for x in "uv")
        open_ = pairs.join(a, F.col("u") == F.col("_u"), "left").join(b, F.col("v") == F.col("_v"), "left")
        open_ = open_.where(F.coalesce("_pu", "u") != F.coalesce("_pv", "v")).select("u", "v", "apart")
        now = written(open_.select("u", "v") if k == rounds else nearest_partners(open_), "simhash-pairs")
        links = joined_to(parts, verified(now, names, docs))
        dropped(now)
    dropped(pairs)
    return links


def similar_groups(docs: DataFrame, reach: int = 2) -> DataFrame:
    """doc_id and component_id of every row: documents joined by fingerprints (of five-word shingles)
    within reach or by similar sets of these shingles."""
    order = Order(common_shingles(docs))
    rows = shingled(docs, order).withColumn("row", F.monotonically_increasing_id())
    rows = written_by_batches(rows, "simhash-shingled")
    # One row stands for all that have its set of shingles: one of the smallest doc_id.
    pick = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("first"), "row"))
    names = rows.groupBy("cls").agg(pick.alias("p"), F.count("*").alias("copies")).select("cls", "p.first", F.col("p.row").alias("picked"), "copies")
    names = written(names, "simhash-names")
    others = attached(rows.select("cls", "row"), names.where("copies > 1").select("cls", "picked", "copies"), "cls", "copies").where("row <> picked")
    others = small_table(others.select("row"), "simhash-others")
    classes = rows.select("row", "cls", "n", "head", "bits", "wide").join(others, "row", "left_anti").drop("row")
    prints = written(rows.groupBy("fp").agg(F.min("cls").alias("first")), "simhash-prints")
    near = links(prints, reach).select(F.col("u.first").alias("u"), F.col("v.first").alias("v"))
    same = rows.select("fp", "cls").distinct().join(prints, "fp").where("cls <> first").select(F.col("cls").alias("u"), F.col("first").alias("v"))
    start = written(near.unionAll(same).distinct(), "simhash-near")
    ends = similar_links(classes, start, names, docs)
    # Nodes carry their smallest doc_id, so that no join by component is needed to name it.
    facts = names.select("cls", F.struct("first", "cls").alias("_x"))
    a, b = (facts.select(F.col("cls").alias(x), F.col("_x").alias(f"_{x}")) for x in "uv")
    ends = ends.join(a, "u").join(b, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    parts = connected_components(ends, "simhash-links")
    named = names.join(parts, F.struct("first", "cls") == F.col("node"), "left")
    named = written(named.select("cls", F.nullif(F.coalesce("component.first", "first"), F.lit(NO_ID)).alias("component_id"), "copies"), "simhash-named")
    out = written(attached(rows.select("doc_id", "cls"), named, "cls", "copies").select("doc_id", "component_id"), "simhash-groups")
    dropped(rows, names, prints, start, named)
    return out


def keep_first_similar(docs: DataFrame, reach: int = 2) -> DataFrame:
    """keep_first for documents joined by fingerprints or by 4/5 of their five-word shingles."""
    return first_of(docs, similar_groups(docs, reach))
