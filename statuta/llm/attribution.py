"""Token counts by offset-mapped attribution.

Every whole document is encoded once. A token's span is known from the bytes it stands for, so
the spans tile the text; they are in bytes, as characters can be split over tokens. Sections tile
it too (lines, each with its line end, or the fields of a row), and an
interval join of both gives each section its tokens. A token that crosses section borders is
allocated by rule: `first` (the section of its first byte), `most` (the section with most of its
bytes, the earlier of equals) or `share` (each section in proportion to its bytes).

A null or empty text has one empty section 0. Null doc_ids and repeated rows are kept. Ties: of
sections with equally many bytes of a token `most` takes the earlier. A text of any length is
encoded whole. Empty tables give empty results. Columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import give_back, written_by_batches
from statuta.llm.tokens import VOCABULARY, byte_lengths, encode_document

RULES = ("first", "most", "share")


def line_borders(data: bytes) -> np.ndarray:
    """Ends of the lines of a text, in bytes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, number of tokens that cross its end)."""
    n = len(section_ends)
    crossing = np.zeros(n, np.int64)
    if not len(token_ends):
        return np.zeros(n), crossing
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    whole = first == last
    out = np.bincount(first if rule == "first" else first[whole], minlength=n).astype(np.float64)
    for t in np.flatnonzero(~whole).tolist():
        a, b = int(first[t]), int(last[t])
        crossing[a:b] += 1
        if rule == "first":
            continue
        edges = np.concatenate([[starts[t]], section_ends[a:b], [token_ends[t]]])
        parts = np.diff(edges)
        if rule == "share":
            out[a : b + 1] += parts / parts.sum()
        else:
            out[a + int(np.argmax(parts))] += 1
    return out, crossing


def counted(texts: Iterator[tuple[str, np.ndarray]], rule: str, vocabulary: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, tokens, crossing tokens) of the sections of each text with the ends of its sections."""
    lengths, rows = byte_lengths(vocabulary), []
    for text, ends in texts:
        tokens, crossing = allocate(np.cumsum(lengths[encode_document(text, vocabulary)]), ends, rule)
        rows.append((np.diff(ends, prepend=0), tokens if rule == "share" else tokens.astype(np.int64), crossing))
    return rows


def result_type(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    return f"n_bytes array<long>, n_tokens array<{'double' if rule == 'share' else 'long'}>, n_crossing array<long>"


def field_tokens(docs: DataFrame, fields: list[str], rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, field, n_bytes, n_tokens, n_crossing: the named fields of a row, one after the other, are one document,
    encoded once; a token over the border of two fields is allocated by the rule. A null field is empty."""

    @F.pandas_udf(result_type(rule))
    def count(*columns: pd.Series) -> pd.DataFrame:
        parts = [[(x or "").encode() for x in row] for row in zip(*columns)]
        rows = counted(((b"".join(p).decode(), np.cumsum([len(x) for x in p])) for p in parts), rule, vocabulary)
        return pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "n_crossing"])

    each = docs.select("doc_id", count(*[F.col(f"`{f}`").cast("string") for f in fields]).alias("c"))
    names = F.array(*[F.lit(f) for f in fields]).alias("field")
    each = each.select("doc_id", F.explode(F.arrays_zip(names, "c.n_bytes", "c.n_tokens", "c.n_crossing")).alias("s"))
    return each.select("doc_id", F.col("s")["field"].alias("field"), "s.n_bytes", "s.n_tokens", "s.n_crossing")


def section_tokens(docs: DataFrame, rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, n_bytes, n_tokens (double for `share`), n_crossing for every section."""

    @F.pandas_udf(result_type(rule))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = counted(((t or "", line_borders((t or "").encode())) for t in texts), rule, vocabulary)
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "n_crossing"])
        give_back()

    each = docs.select("doc_id", count("text").alias("c"))
    each = each.select("doc_id", F.posexplode(F.arrays_zip("c.n_bytes", "c.n_tokens", "c.n_crossing")).alias("section", "s"))
    return written_by_batches(each.select("doc_id", "section", "s.n_bytes", "s.n_tokens", "s.n_crossing"), "attribution-sections")
