"""Vector best-fit packing of tokenised documents into sequences.

A document's ids end with one end id; a longer one than a sequence is cut into whole sequences,
its first piece taking the remainder. A piece needs tokens, one place among the documents of a
sequence, and attention cost (its length squared; a full piece alone has the cost of a sequence, so
with sequences of one size that capacity is never short before tokens are, and cost decides
placements by its weight). Longest first, each piece goes to the open
sequence whose weighted residual norm (or dot product with the piece) is best among those that
can hold it under every constraint; if none can, a new one opens.

Pieces of one length are alike and sequences with one residual are alike, so the plan is made on
counts: the histogram of lengths (at most `capacity` numbers) goes in, runs of equal placements
come out. Pieces are ranked within their length by a salted two-level rank and look their run up.

Nulls: a null text is empty (it still has its end id), a null doc_id is kept. Repeated rows are
packed as documents of their own. Ties: of sequences that are equally good the one opened first is
taken; pieces of one length are placed in the order of a hash. A text of any length is encoded
whole. Empty tables give empty results. Columns other than doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, grouped_prefix, written_by_batches
from statuta.llm.tokens import VOCABULARY, encode_document

END = 2
#: Weights of tokens, documents and attention cost in the residual norm.
WEIGHTS = (1.0, 1.0, 1.0)


def pieces(docs: DataFrame, capacity: int = 1024, end: int = END, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document cut to the capacity."""
    kind = "n long, crc array<long>" + (", ids array<array<int>>" if with_ids else "")

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        stop = np.array([end], np.uint32)
        for texts in batches:
            rows = []
            for t in texts:
                ids = np.concatenate([encode_document(t or "", vocabulary), stop])
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                parts = [ids[a:b] for a, b in zip(edges, edges[1:])]
                row = (len(ids), [zlib.crc32(p) for p in parts])
                rows.append((*row, [p.astype(np.int32) for p in parts]) if with_ids else row)
            yield pd.DataFrame(rows, columns=["n", "crc", "ids"][: 2 + with_ids])
        give_back()

    cuts = docs.select("doc_id", cut("text").alias("c")).select("doc_id", "c.*")
    each = cuts.select("doc_id", "n", F.size("crc").alias("m"), F.posexplode("crc").alias("piece", "ids_crc32"), *(["ids"] if with_ids else []))
    first = F.col("n") - (F.col("m") - 1) * capacity
    return each.select(
        "doc_id", "piece",
        F.when(F.col("piece") == 0, 0).otherwise(first + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(F.col("piece") == 0, first).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32", *([F.get("ids", "piece").alias("ids")] if with_ids else []),
    )


def plan(counts: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """Runs (length, first rank, how many, first sequence, offset), one placement of `how many`
    pieces of a length into as many consecutive sequences at one offset."""
    full = np.array([capacity, max_docs, max_cost], np.float64)
    w = np.array(weights)
    residual, base, size = np.zeros((0, 3)), [], []  # groups of sequences with one residual
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        need, left, rank = np.array([length, 1, length * length], np.float64), counts[length], 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        while left:
            fits = np.flatnonzero((residual >= need).all(1))
            if not len(fits):
                break
            after = (residual[fits] - need) / full
            score = (w * after**2).sum(1) if rule == "norm" else -(w * (need / full) * (residual[fits] / full)).sum(1)
            g = int(fits[np.argmin(score)])
            k = min(left, size[g])
            runs.append((length, rank, k, base[g], capacity - int(residual[g, 0])))
            if k < size[g]:  # the rest of the group keeps its residual
                residual = np.vstack([residual, residual[g]])
                base.append(base[g] + k)
                size.append(size[g] - k)
                size[g] = k
            residual[g] -= need
            left, rank = left - k, rank + k
        if left:  # new sequences, each filled with as many of this length as it holds
            holds = int(min(full // need))
            for many, each in ((left // holds, holds), (1 if left % holds else 0, left % holds)):
                if many:
                    for i in range(each):
                        runs.append((length, rank, many, sequences, i * length))
                        rank += many
                    residual = np.vstack([residual, full - each * need])
                    base.append(sequences)
                    size.append(many)
                    sequences += many
        shortest = min((x for x in counts if x < length), default=0)
        keep = np.flatnonzero((residual[:, 0] >= shortest) & (residual[:, 1] >= 1))
        residual, base, size = residual[keep], [base[i] for i in keep], [size[i] for i in keep]
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(
    cut: DataFrame, capacity: int = 1024, max_docs: int = 1024, max_cost: int = 1024 * 1024,
    weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm",
) -> DataFrame:
    """Columns of `cut` (a written table of pieces with length) plus sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity, max_docs, max_cost, weights, rule)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 40) + runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n = rank.to_numpy(np.int64)
        r = runs[np.searchsorted(keys, (length.to_numpy(np.int64) << 40) + n, side="right") - 1]
        return pd.DataFrame({"sequence_id": r[:, 3] + n - r[:, 1], "offset": r[:, 4]})

    hashed = cut.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_one", F.lit(1))
    ranked = grouped_prefix(hashed, ["length"], ["_h", "doc_id", "piece", "ids_crc32"], "_one", 256, "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(*cut.columns, "_at.sequence_id", "_at.offset")


def packed_documents(docs: DataFrame, capacity: int = 1024, with_ids: bool = False, **limits) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack(written_by_batches(pieces(docs, capacity, with_ids=with_ids), "packing-pieces"), capacity, **limits)
