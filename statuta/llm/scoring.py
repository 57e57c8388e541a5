"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy on the executors.

Words (lower-cased, split at blanks) fall into hash buckets; the counts of all buckets over the
whole corpus choose the vocabulary: the most frequent buckets are tokens of their own, the others
share the remaining tokens. The network predicts a token from the `reach` tokens on either side:
embeddings by position are summed, squashed and scored in two steps (group of tokens, token in its
group), so that every probability is normalised. Documents are encoded once, as a table of tokens,
and dealt by a hash over as many shards as the corpus has SHARD words; each shard trains its own
copy on a share of all its positions, and copies are averaged by their positions in every round,
by a tree of sums. Shards and the order within them follow from the documents alone, so results
don't depend on how the input is split. Words of one token are told apart by the corpus: a table
counts every word, and a word's probability within its token is its share of the token's
occurrences. A document's score is the sum of the log-probabilities of all its words, each given
the tokens on both sides.

Nulls: a null or empty text has n_tokens 0, log_likelihood 0 and a null per_token. Null doc_ids
and repeated rows are kept. Ties: buckets of equal counts go by number. A text of any length is
encoded whole and scored in stretches. Empty tables give empty results. Columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import dropped, give_back, written, written_by_batches

#: Hash buckets of words; groups of tokens and tokens of a group; frequent buckets with a token of
#: their own; width; tokens on each side; positions of a step; tokens of a batch of documents.
BUCKETS, GROUPS, EACH, OWN, WIDTH, REACH, STEP, BATCH = 1 << 16, 32, 32, 512, 16, 2, 2048, 1 << 16
TOKENS = GROUPS * EACH
#: Most frequent words whose counts every task holds (the others' are joined); words of a shard; copies summed by a task.
HELD, SHARD, FAN = 1 << 17, 1 << 21, 32


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text."""
    words = (text or "").lower().encode().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def buckets_of(text: str | None) -> np.ndarray:
    return (words_of(text) % np.uint64(BUCKETS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), n: occurrences of every word over all documents, as a written table."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(words_of, f["text"])]), return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})

    rows = docs.select("text").mapInPandas(count, "word long, n long")
    return written_by_batches(rows.groupBy("word").agg(F.sum("n").alias("n")), "scoring-words")


def bucket_counts(words: DataFrame) -> np.ndarray:
    """Occurrences of every bucket, from those of words."""
    rows = words.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every bucket over all documents."""
    return bucket_counts(word_counts(docs))


def vocabulary(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of every bucket, occurrences of every token)."""
    order = np.argsort(-counts, kind="stable")
    token = np.empty(BUCKETS, np.int64)
    token[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:]
    token[rest] = OWN + np.arange(len(rest)) % (TOKENS - OWN)
    # Deal tokens over groups so that every group has frequent and rare ones.
    token = token % GROUPS * EACH + token // GROUPS
    return token, np.bincount(token, weights=counts, minlength=TOKENS)


class Network:
    """Parameters as one flat vector with named views."""

    SHAPES = {"embed": (2 * REACH, TOKENS + 1, WIDTH), "bias": (WIDTH,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,),
              "inner": (GROUPS, WIDTH), "each": (WIDTH, EACH), "each_bias": (GROUPS, EACH)}

    def __init__(self, flat: np.ndarray | None = None) -> None:
        sizes = [int(np.prod(s)) for s in self.SHAPES.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for (name, shape), n in zip(self.SHAPES.items(), sizes):
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, occurrences: np.ndarray) -> Network:
        """Small random weights; biases at the tokens' overall frequencies."""
        net = cls(np.random.default_rng(5).normal(0, 0.1, cls().flat.size))
        p = (occurrences + 1).reshape(GROUPS, EACH)
        net.group_bias[:] = np.log(p.sum(1) / p.sum())
        net.each_bias[:] = np.log(p / p.sum(1, keepdims=True))
        return net

    def forward(self, around: np.ndarray, token: np.ndarray):
        h = self.bias + self.embed[0][around[0]]
        for k in range(1, 2 * REACH):
            h = h + self.embed[k][around[k]]
        h = np.tanh(h)
        g, e = token // EACH, token % EACH
        pg = h @ self.group + self.group_bias
        pg -= pg.max(1, keepdims=True)
        zg = np.exp(pg)
        sg = zg.sum(1)
        h2 = h + self.inner[g]
        pe = h2 @ self.each + self.each_bias[g]
        pe -= pe.max(1, keepdims=True)
        ze = np.exp(pe)
        se = ze.sum(1)
        i = np.arange(len(token))
        return pg[i, g] - np.log(sg) + pe[i, e] - np.log(se), (h, h2, zg / sg[:, None], ze / se[:, None], g, e, i)

    def gradient(self, around: np.ndarray, token: np.ndarray) -> Network:
        """Of the mean log-probability."""
        _, (h, h2, pg, pe, g, e, i) = self.forward(around, token)
        n, out = len(token), Network()
        dg, de = -pg, -pe
        dg[i, g] += 1
        de[i, e] += 1
        out.group[:], out.group_bias[:] = h.T @ dg / n, dg.sum(0) / n
        out.each[:] = h2.T @ de / n
        one = np.zeros((n, GROUPS), np.float32)
        one[i, g] = 1
        out.each_bias[:] = one.T @ de / n
        dh2 = de @ self.each.T
        out.inner[:] = one.T @ dh2 / n
        dx = (dg @ self.group.T + dh2) * (1 - h * h)
        out.bias[:] = dx.sum(0) / n
        for k in range(2 * REACH):
            for d in range(WIDTH):
                out.embed[k][:, d] = np.bincount(around[k], weights=dx[:, d], minlength=TOKENS + 1) / n
        return out


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens around, token, document) of every position; TOKENS stands beyond either end."""
    pad = np.full(REACH, TOKENS)
    flat = np.concatenate([pad, *chain.from_iterable((d, pad) for d in docs)])
    doc = np.concatenate([pad * 0 - 1, *chain.from_iterable((np.full(len(d), i), pad * 0 - 1) for i, d in enumerate(docs))])
    at = np.flatnonzero(doc >= 0)
    offsets = [k for k in range(-REACH, REACH + 1) if k]
    return np.stack([flat[at + k] for k in offsets]), flat[at], doc[at]


def batches_of(docs: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and tokens of documents with words, in batches of about BATCH tokens."""
    rows, held, n = [], [], 0
    for i, ids in enumerate(docs):
        if len(ids):
            rows.append(i), held.append(ids)
            n += len(ids)
        if n >= BATCH:
            yield rows, held
            rows, held, n = [], [], 0
    if held:
        yield rows, held


def encoded(docs: DataFrame, token: np.ndarray, occurrences: np.ndarray, known: np.ndarray, log_known: np.ndarray, shards: int) -> DataFrame:
    """A written table of all rows: row, doc_id, shard, place in it, tokens (16 bits each), rare (words that are not
    held) and within (log counts of the held words less those of all tokens: with those of the rare words, log shares)."""
    model = docs.sparkSession.sparkContext.broadcast((token.astype(np.uint16), np.log(np.maximum(occurrences, 1)), known, log_known))

    @F.pandas_udf("tokens binary, within double, rare array<long>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        token, log_token, known, log_known = model.value
        for texts in batches:
            out = []
            for t in texts:
                w = words_of(t)
                ids = token[w % np.uint64(BUCKETS)]
                within, rare = -log_token[ids].sum(), w
                if len(known) and len(w):
                    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    there = known[at] == w
                    within, rare = within + log_known[at[there]].sum(), w[~there]
                out.append((ids.tobytes(), float(within), rare.view(np.int64)))
            yield pd.DataFrame(out, columns=["tokens", "within", "rare"])
        give_back()

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), encode("text").alias("e")).select("doc_id", "place", "e.*")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards))).withColumn("row", F.monotonically_increasing_id())
    return written_by_batches(rows, "scoring-tokens")


def averaged(copies: DataFrame) -> tuple[np.ndarray, int] | None:
    """Mean of the copies (shard, weight, flat), summed FAN at a time, and their weight."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        flat = sum(np.frombuffer(b, np.float64) for b in f["flat"])
        return pd.DataFrame({"shard": [f["shard"].iloc[0] // FAN], "weight": [f["weight"].sum()], "flat": [flat.tobytes()]})

    kind = "shard long, weight long, flat binary"
    copies = written(copies, "scoring-copies")
    while copies.count() > 1:
        summed = written(copies.groupBy(F.floor(F.col("shard") / FAN)).applyInPandas(add, kind), "scoring-copies")
        dropped(copies)
        copies = summed
    last = copies.first()
    dropped(copies)
    return (np.frombuffer(last["flat"], np.float64) / last["weight"], last["weight"]) if last else None


def trained(rows: DataFrame, net: Network, share: int, rate: float, seed: int) -> Network:
    """One round: every shard improves a copy on 1 in `share` of its positions; the mean of the copies."""

    def train(f: pd.DataFrame) -> pd.DataFrame:
        own, seen = Network(net.flat.copy()), 0
        power = np.full(own.flat.size, 1e-6, np.float32)
        rng = np.random.default_rng(seed)
        f = f.sort_values(["place", "tokens"])
        for _, held in batches_of([np.frombuffer(b, np.uint16) for b in f["tokens"]]):
            around, target, _ = windows(held)
            chosen = rng.permutation(np.flatnonzero((np.arange(len(target)) + seed) % share == 0))
            for at in range(0, len(chosen), STEP):
                k = chosen[at : at + STEP]
                g = own.gradient(around[:, k], target[k]).flat
                power += g * g
                own.flat += rate * g / np.sqrt(power)
            seen += len(chosen)
        shard = int(f["shard"].iloc[0])
        del f
        give_back()
        return pd.DataFrame({"shard": [shard], "weight": [seen], "flat": [(own.flat.astype(np.float64) * seen).tobytes()]})

    copies = rows.where(F.length("tokens") > 0).select("shard", "place", "tokens").groupBy("shard").applyInPandas(train, "shard long, weight long, flat binary")
    mean = averaged(copies)
    return Network(mean[0]) if mean and mean[1] else net


def held_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word, n) of the most frequent words, sorted by word: all whose count reaches the least eighth of an octave
    that at most HELD words reach. That level comes from a histogram of a few hundred rows."""
    level = F.floor(F.log2("n") * 8)
    sizes = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fits = sizes["level"][sizes["words"].cumsum() <= HELD]
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0)
    top = words.where(level >= int(fits.min())).select("word", "n").toArrow()  # at most HELD rows
    known, times = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.float64)
    by = np.argsort(known)
    return known[by], times[by]


def fit(docs: DataFrame, rounds: int = 2, share: int = 2, rate: float = 0.1, words: DataFrame | None = None) -> tuple[np.ndarray, Network, DataFrame]:
    """(token of every bucket, network, table of encoded documents).

    Rounds r = 0, 1, ... take positions p with (p + r) % share = 0: `share` rounds go over all once.
    """
    words = word_counts(docs) if words is None else words
    counts = bucket_counts(words)
    token, occurrences = vocabulary(counts)
    known, times = held_words(words)
    shards = max(1, -(-int(counts.sum()) // SHARD))
    rows = encoded(docs, token, occurrences, known, np.log(times), shards)
    net = Network.start(occurrences)
    for r in range(rounds):
        net = trained(rows, net, share, rate / (1 + r), r)
    return token, net, rows


def pseudo_likelihood(docs: DataFrame, **training) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of every row."""
    words = word_counts(docs)
    _, net, rows = fit(docs, words=words, **training)
    flat = net.flat

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network(flat)
        for blobs in batches:
            total = np.zeros(len(blobs))
            for rows, held in batches_of([np.frombuffer(b, np.uint16) for b in blobs]):
                around, target, doc = windows(held)
                for at in range(0, len(target), 1 << 14):
                    s = slice(at, at + (1 << 14))
                    logs, _ = net.forward(around[:, s], target[s])
                    total += np.bincount(np.array(rows)[doc[s]], weights=logs, minlength=len(total))
            yield pd.Series(total)
        give_back()

    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word")
    rare = rare.groupBy(F.col("row").alias("_row")).agg(F.sum(F.log("n")).alias("more"))
    n = (F.length("tokens") / 2).cast("long").alias("n_tokens")
    scored = rows.select("row", "doc_id", n, (score("tokens") + F.col("within")).alias("known"))
    out = scored.join(rare, F.col("row") == F.col("_row"), "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
