"""Substring dedup by super-k-mers of words.

A window is `width` consecutive words of one document. Its minimiser is the smallest word by a
hash order in which very frequent words (learned from a bounded sample) come last. Consecutive
windows with one minimiser form a super-k-mer, which travels as one string to the minimiser's
bucket; there sorting brings equal windows together and gives each its smallest doc_id. Windows
of later documents are sent back as word ranges, and each document drops its ranges.

Of equal super-k-mers met in one batch only those of the smallest doc_id travel: all others are
known to repeat. A task remembers those that repeated in its batches, so a passage of millions of
copies reaches its bucket a few times a task; windows across its borders are dealt by the rare words
around it. Minimisers that would fill a bucket by themselves, found by bytes in a share of all
documents, are split: their windows are dealt by their three smallest words together.

Nulls: a null text has no words; a null doc_id is larger than all ids, and windows of rows without
ids don't remove each other. Ties: rows that repeat a doc_id are judged alike and all returned; a
window is only removed for a smaller doc_id. A text of any length is one row, its words are held at
once; batches and buckets are bounded in words. Empty tables give empty results. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import NO_ID, fresh, give_back, partitions_of, text_parts, written_by_batches

#: Documents of the sample for frequent words, a word's share of them that makes it frequent,
#: most frequent words held; words of a batch; buckets for each input split; level of compression.
SAMPLE, SHARE, FREQUENT, BATCH, BUCKETS, LEVEL = 4096, 0.01, 1 << 14, 200_000, 16, 6
#: Bytes of super-k-mers of one minimiser past which it is split, the share of documents by which they are
#: told (1 in), words that deal a split minimiser's windows; bytes of repeated strings that a task remembers.
HOT_BYTES, HOT_SAMPLE, DEPTH, REMEMBERED = 1 << 26, 64, 3, 1 << 23
#: Bytes of text that are words at a time.
SLICE = 1 << 20
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


#: Words joined by blanks, their hashes and lengths: a few bytes a word, where words of their own would be fifty.
Read = tuple[bytes, np.ndarray, np.ndarray]


def read(words: list[bytes]) -> Read:
    return b" ".join(words), word_hashes(words), np.fromiter(map(len, words), np.int64, len(words))


def super_kmers(docs: list[list[bytes]], width: int, frequent: np.ndarray, hot: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(strings, minimiser, document, first word, windows) of a batch's super-k-mers."""
    return kmers_of([read(d) for d in docs], width, frequent, hot)


def kmers_of(docs: list[Read], width: int, frequent: np.ndarray, hot: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of documents as read."""
    sizes = np.array([len(h) for _, h, _ in docs], np.int64)
    none = np.zeros(0, np.int64)
    if sizes.sum() < width:
        return [], none.astype(np.uint64), none, none, none
    h = np.concatenate([h for _, h, _ in docs])
    rank = h >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        rank = np.where(frequent[at] == h, rank | np.uint64(1 << 63), rank)
    doc = np.repeat(np.arange(len(docs)), sizes)
    del h
    least = sliding_min(rank, width)
    valid = doc[: len(least)] == doc[width - 1 :]
    if len(hot):
        at = np.minimum(np.searchsorted(hot, least), len(hot) - 1)
        split = np.flatnonzero((hot[at] == least) & valid)
        several = np.sort(rank[split[:, None] + np.arange(width)], axis=1)[:, :DEPTH]
        least[split] = (several * powers(R, DEPTH + 1)[1:]).sum(1, dtype=np.uint64)
    cut = np.ones(len(least) + 1, bool)
    cut[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
    del rank
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:]
    keep = valid[begin]
    begin, end = begin[keep], end[keep]
    lengths = np.concatenate([x for _, _, x in docs])
    byte = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = b" ".join(t for t, h, _ in docs if len(h))
    last = end + width - 2
    strings = [text[a:b] for a, b in zip(byte[begin].tolist(), (byte[last] + lengths[last]).tolist())]
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return strings, least[begin], doc[begin], begin - start[doc[begin]], end - begin


def merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of word ranges [first, last) by document."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    reach = last + doc * (1 << 40)
    reach = np.maximum.accumulate(reach)
    begins = np.ones(len(doc), bool)
    begins[1:] = first[1:] + doc[1:] * (1 << 40) > reach[:-1]
    ends = np.append(begins[1:], True)
    return doc[begins], first[begins], reach[ends] - doc[begins] * (1 << 40)


def range_rows(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict:
    """One row a document: its ranges as 32-bit pairs."""
    doc, first, last = merged(doc, first, last)
    which, at = np.unique(doc, return_index=True)
    pairs = np.stack([first, last], 1).astype(np.int32)
    blobs = [p.tobytes() for p in np.split(pairs, at[1:])] if len(which) else []
    return {"doc_id": ids[which], "key": keys[which], "ranges": blobs}


ROW = "bucket int, doc_id long, key long, ranges binary, packed binary"
ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("ranges", pa.binary()), ("packed", pa.binary())])


def pack(strings: list[bytes], doc: np.ndarray, first: np.ndarray, ids: np.ndarray, keys: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    which, local = np.unique(doc, return_inverse=True)
    head = np.array([len(strings), len(which)], np.int64).tobytes()
    numbers = np.concatenate([np.diff(local, prepend=0), first]).astype(np.int32).tobytes()
    # Ids ascend within a batch, so their differences are small numbers that compress well.
    return squeeze.compress(head + np.diff(ids[which], prepend=0).tobytes() + keys[which].tobytes() + numbers + b"\n".join(strings))


def unpack(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(strings joined by newlines, doc_id, key, first word) of a packed bucket part."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    ids, keys = np.cumsum(np.frombuffer(raw, np.int64, m, 16)), np.frombuffer(raw, np.int64, m, 16 + 8 * m)
    local = np.cumsum(np.frombuffer(raw, np.int32, n, 16 + 16 * m))
    first = np.frombuffer(raw, np.int32, n, 16 + 16 * m + 4 * n)
    return raw[16 + 16 * m + 8 * n :], ids[local], keys[local], first


#: Bytes whose powers are held at a time.
STRETCH = 1 << 16


def rolling_sums(buffer: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
    """Sums of (byte + 1) * R**place before the given ascending places, modulo 2**64; no byte of a text is 255."""
    out = [np.zeros(len(x), np.uint64) for x in at]
    factor, before = powers(R, STRETCH), np.uint64(0)
    step, scale = np.uint64(pow(R, STRETCH, 1 << 64)), np.uint64(1)
    with np.errstate(over="ignore"):
        for p in range(0, len(buffer) + 1, STRETCH):
            part = buffer[p : p + STRETCH]
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part + np.uint64(1)) * factor[: len(part)] * scale, dtype=np.uint64)]) + before
            for x, o in zip(at, out):
                i, j = np.searchsorted(x, [p, p + STRETCH])
                o[i:j] = sums[x[i:j] - p]
            before, scale = sums[-1], scale * step
    return out


def repeated_windows(data: bytes, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(super-k-mer, window in it) of all windows that also start in a smaller doc_id.

    data: super-k-mers joined by newlines. Windows are sorted by a rolling hash of their bytes; of
    windows with one hash the bytes themselves are compared.
    """
    buffer = np.frombuffer(data, np.uint8)
    sep = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts, ends = np.concatenate([[0], sep + 1]), np.append(sep, len(buffer))
    kmer = np.concatenate([[0], np.cumsum(buffer[sep] == 10)])
    first = np.searchsorted(kmer, np.arange(kmer[-1] + 1))
    begin = np.flatnonzero(kmer[: len(kmer) - width + 1] == kmer[width - 1 :])
    a, b, kmer_of = starts[begin], ends[begin + width - 1], kmer[begin]
    del sep, kmer
    low, high = rolling_sums(buffer, starts, ends)
    h = high[begin + width - 1] - low[begin]
    del low, high, starts, ends
    near, far = powers(R_INVERSE, STRETCH), powers(pow(R_INVERSE, STRETCH, 1 << 64), len(buffer) // STRETCH + 1)
    h *= near[a % STRETCH] * far[a // STRETCH]
    del near, far
    doc = ids[kmer_of]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    del h
    run = np.cumsum(fresh) - 1
    lead = np.flatnonzero(fresh)  # each run's smallest document
    later = np.flatnonzero(doc > doc[lead[run]])
    wins, firsts = order[later], order[lead[run[later]]]
    same = np.fromiter((data[p:q] == data[r:s] for p, q, r, s in zip(a[wins].tolist(), b[wins].tolist(), a[firsts].tolist(), b[firsts].tolist())), bool, len(wins))
    flagged = [wins[same]]
    for r in np.unique(run[later[~same]]):  # two different windows with one hash: by their bytes
        least: dict[bytes, int] = {}
        members = order[run == r]
        for w in members.tolist():
            text = data[a[w] : b[w]]
            least[text] = min(least.get(text, NO_ID), int(ids[kmer_of[w]]))
        flagged.append(np.array([w for w in members.tolist() if ids[kmer_of[w]] > least[data[a[w] : b[w]]]], np.int64))
    hit = np.unique(np.concatenate(flagged).astype(np.int64))
    return kmer_of[hit], begin[hit] - first[kmer_of[hit]]


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of words in over SHARE of a sample of about SAMPLE documents (all, if fewer)."""
    n = docs.count()
    one_in = max(1, n // SAMPLE)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(one_in)) == 0).select("text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = [set((t or "").encode().split()) for t in f["text"]]
            h = word_hashes([w for s in words for w in s]).view(np.int64)
            value, times = np.unique(h, return_counts=True)
            yield pd.DataFrame({"h": value, "n": times})
        give_back()

    counts = drawn.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(2, int(SHARE * n / one_in))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def hot_minimisers(docs: DataFrame, width: int, frequent: np.ndarray) -> np.ndarray:
    """Sorted minimisers whose super-k-mers have over HOT_BYTES bytes, told from a share of all documents.

    They are at most one for every HOT_BYTES bytes of super-k-mers.
    """
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(HOT_SAMPLE)) == 0).select("text")

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            strings, least, *_ = super_kmers([(t or "").encode().split() for t in f["text"]], width, frequent, np.zeros(0, np.uint64))
            value, at = np.unique(least, return_inverse=True)
            yield pd.DataFrame({"least": value.view(np.int64), "n": np.bincount(at, weights=[len(x) for x in strings], minlength=len(value)).astype(np.int64)})
        give_back()

    sums = drawn.mapInPandas(weigh, "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    top = sums.where(F.col("n") * HOT_SAMPLE > HOT_BYTES).select("least").toPandas()["least"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def text_key(docs: DataFrame) -> Column:
    """Tells apart rows that share a doc_id but not their text; 0 where no doc_id repeats."""
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return F.lit(0).cast("long") if repeats.isEmpty() else F.xxhash64("text")


def removed_ranges(docs: DataFrame, key: Column, width: int = 13) -> DataFrame:
    """doc_id (NO_ID for null), key, ranges: word ranges to drop, an array of binaries a document."""
    frequent = frequent_words(docs)
    hot = hot_minimisers(docs, width, frequent)
    buckets = max(8, BUCKETS * partitions_of(docs))
    source = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), key.alias("key"), "text").where("text IS NOT NULL")

    def send(ids: list[int], keys: list[int], docs: list[Read], sent: dict[bytes, int]) -> pd.DataFrame:
        order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
        ids, keys = np.array(ids, np.int64)[order], np.array(keys, np.int64)[order]
        strings, least, doc, first, n = kmers_of([docs[i] for i in order], width, frequent, hot)
        seen: dict[bytes, int] = {}
        lead = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
        known = ids[doc] > ids[doc[lead]] if len(strings) else np.zeros(0, bool)
        # Strings that repeated in this or an earlier batch: has a smaller doc_id sent them?
        late = []
        for i in set(lead[known].tolist()) | {seen[s] for s in sent.keys() & seen.keys()}:
            mine = int(ids[doc[i]])
            if sent.get(strings[i], NO_ID) < mine:
                late.append(i)
            else:
                sent[strings[i]] = mine
        known |= np.isin(lead, late)
        if sum(map(len, sent)) > REMEMBERED:
            sent.clear()
        out = range_rows(ids, keys, doc[known], first[known], first[known] + n[known] + width - 1)
        rows = [(int(d) % buckets, int(d), int(k), r, None) for d, k, r in zip(out["doc_id"], out["key"], out["ranges"])]
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        live = np.flatnonzero(~known)
        bucket = ((least[live] * np.uint64(R)) >> np.uint64(33)).astype(np.int64) % buckets
        live = live[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket, kind="stable")
        which, at = np.unique(bucket, return_index=True)
        for b, part in zip(which.tolist(), np.split(live, at[1:])) if len(which) else ():
            rows.append((b, 0, 0, None, pack([strings[i] for i in part.tolist()], doc[part], first[part], ids, keys, squeeze)))
        return pd.DataFrame(rows, columns=["bucket", "doc_id", "key", "ranges", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held, n, sent = [], [], [], 0, {}
        to_arrow = functools.partial(pa.RecordBatch.from_pandas, schema=ARROW, preserve_index=False)
        for part in (p for b in batches for p in text_parts(b, most=SLICE)):
            for i, k, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                words = t.encode().split()
                if len(words) < width:
                    continue
                ids.append(i), keys.append(k), held.append(read(words))
                n += len(words)
                if n >= BATCH:
                    yield to_arrow(send(ids, keys, held, sent))
                    ids, keys, held, n = [], [], [], 0
                    give_back()
        if held:
            yield to_arrow(send(ids, keys, held, sent))
            ids, keys, held = [], [], []
        give_back()

    def resolved(f: pd.DataFrame) -> pd.DataFrame:
        done = f[f["packed"].isna()]
        known = [done[["doc_id", "key", "ranges"]]]
        parts = [unpack(b) for b in f["packed"].dropna()]
        if parts:
            data = b"\n".join(p[0] for p in parts)
            ids, keys, first = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            del parts
            kmer, window = repeated_windows(data, ids, width)
            if len(kmer):
                # Documents as dense numbers, by doc_id and text.
                pair = np.stack([ids, keys], 1)
                names, dense = np.unique(pair, axis=0, return_inverse=True)
                at = first[kmer].astype(np.int64) + window
                known.append(pd.DataFrame(range_rows(names[:, 0], names[:, 1], dense.ravel()[kmer], at, at + width)))
        return pd.concat(known)

    def resolve(f: pd.DataFrame) -> pd.DataFrame:
        out = resolved(f)
        give_back()
        return out

    sent = source.mapInArrow(cut, ROW)
    back = sent.groupBy("bucket").applyInPandas(resolve, "doc_id long, key long, ranges binary")
    return back.groupBy("doc_id", "key").agg(F.collect_list("ranges").alias("ranges"))


def kept(text: str | None, ranges) -> tuple[list[bytes], np.ndarray]:
    """A text's words and which of them stay."""
    words = [] if text is None else text.encode().split()
    keep = np.ones(len(words), bool)
    for blob in ranges if ranges is not None else ():
        for a, b in np.frombuffer(blob, np.int32).reshape(-1, 2).tolist():
            keep[a:b] = False
    return words, keep


def joined(words: list[bytes], keep: np.ndarray) -> bytes:
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])


def with_ranges(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc, ranges): docs as one struct; the small side is hashed, texts are dealt but not sorted."""
    key = text_key(docs)
    ranges = written_by_batches(removed_ranges(docs, key, width), "substrings-ranges")
    rows = docs.select(fresh(docs).alias("doc"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("_d"), key.alias("_k"))
    r = ranges.select(F.col("doc_id").alias("_e"), F.col("key").alias("_l"), "ranges").hint("shuffle_hash")
    return rows.join(r, (F.col("_d") == F.col("_e")) & (F.col("_k") == F.col("_l")), "left").select("doc", "ranges")


def digests(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, as a written table."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts, ranges):
            words, keep = kept(t, r)
            out.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(joined(words, keep)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    rows = with_ranges(docs.select("doc_id", "text"), width)
    return written_by_batches(rows.select("doc.doc_id", digest("doc.text", "ranges").alias("d")).select("doc_id", "d.*"), "substrings-digests")


def cleaned(docs: DataFrame, width: int = 13) -> DataFrame:
    """The documents without repeated passages, columns as given.

    Where nothing is removed the text is unchanged, else it is the kept words joined by blanks and
    n_chars follows. A document that had words goes if none is left.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, ranges):
            words, keep = kept(t, r)
            out.append(joined(words, keep).decode() if keep.any() else None)
        return pd.Series(out, dtype=object)

    rows = with_ranges(docs, width).withColumn("new", clean(F.when(F.col("ranges").isNotNull(), F.col("doc.text")), "ranges"))
    cut = F.col("ranges").isNotNull()
    rows = rows.where(~cut | F.col("new").isNotNull())
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    columns["text"] = F.when(cut, F.col("new")).otherwise(columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("new").cast("long")).otherwise(columns["n_chars"])
    return rows.select(*[v.alias(c) for c, v in columns.items()])
