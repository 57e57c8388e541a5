"""Counts of many phrases in one pass over a text.

All phrases, and the traps that mislead them, are in one automaton of characters with failure links, which goes to the tasks once.
A phrase counts where no letter, digit or underscore stands before or after it, occurrences of one phrase
don't overlap, and each place of a trap (borders or not) takes one off; counts are 0 at least. Texts are put in lower case
first; phrases are taken as they are, so they should be in lower case, too.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.parts import mapped
from statuta.functions.text import HELD_BY, RESTRICTIONS, TRAPS

#: Phrases that a lexicon may hold: it lies in the memory of every task.
MOST = 100_000


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


class Phrases:
    """Counts the phrases of a list; numbers of phrases are their places in it."""

    def __init__(self, terms: Iterable[str], traps: Mapping[str, Sequence[str]] | None = None) -> None:
        self.terms = list(dict.fromkeys(t for t in terms if t))
        traps = TRAPS if traps is None else traps
        self.traps = {t: tuple(x for x in traps[t] if x) for t in self.terms if traps.get(t)}
        if len(self.terms) > MOST:
            raise ValueError(f"at most {MOST} phrases at a time")

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "traps": self.traps}

    @cached_property
    def automaton(self):
        """Every phrase and trap with its length, the number of the phrase that it is (or -1) and those that it misleads."""
        import ahocorasick

        number = {t: i for i, t in enumerate(self.terms)}
        misled: dict[str, list[int]] = {}
        for t, xs in self.traps.items():
            for x in xs:
                misled.setdefault(x, []).append(number[t])
        out = ahocorasick.Automaton()
        for word in {*number, *misled}:
            out.add_word(word, (len(word), number.get(word, -1), tuple(misled.get(word, ())), word))
        out.make_automaton()
        return out

    def counts(self, text: str | None) -> dict[int, int]:
        """Numbers of the phrases that a text has, with how often."""
        found: dict[int, int] = {}
        if not text or not self.terms:
            return found
        low = text.lower()
        taken: dict[int, int] = {}
        trapped: dict[int, int] = {}
        passed: dict[str, int] = {}
        for last, (size, n, misled, word) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            if n >= 0 and start >= taken.get(n, 0) and not (start and _letter(low[start - 1])) and not (end < len(low) and _letter(low[end])):
                found[n] = found.get(n, 0) + 1
                taken[n] = end
            if misled and start >= passed.get(word, 0):
                passed[word] = end
                for m in misled:
                    trapped[m] = trapped.get(m, 0) + 1
        return {n: c - trapped.get(n, 0) for n, c in found.items() if c > trapped.get(n, 0)}


def phrase_counts(text: Column, terms: Iterable[str], traps: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Array of (term, n) of the phrases found, in the order of the list; an empty one for null."""
    p = Phrases(terms, traps)

    kind = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())]))

    @F.arrow_udf("array<struct<term:string,n:int>>")
    def count(texts: pa.Array) -> pa.Array:
        return mapped(lambda t: [{"term": p.terms[i], "n": n} for i, n in sorted(p.counts(t).items())], kind, texts)

    return count(text)


def weighted_total(text: Column, weights: Mapping[str, float] | None = None, held_by: Mapping[str, Sequence[str]] | None = None, traps: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sum of weight * count over terms; what a longer term holds isn't counted again."""
    weights, held_by = dict(weights or RESTRICTIONS), dict(HELD_BY if held_by is None else held_by)
    p = Phrases([*weights, *(x for xs in held_by.values() for x in xs)], traps)
    number = {t: i for i, t in enumerate(p.terms)}
    parts = [(number[t], w, [number[x] for x in held_by.get(t, ())]) for t, w in weights.items() if t]

    def total(t: str | None) -> float:
        n = p.counts(t)
        return sum((max(0, n.get(i, 0) - sum(n.get(j, 0) for j in longer)) * w for i, w, longer in parts), 0.0)

    @F.arrow_udf("double")
    def add(texts: pa.Array) -> pa.Array:
        return mapped(total, pa.float64(), texts)

    return add(text)


def points(title: Column, body: Column, terms: Iterable[str], head: int | None = None, weight: int = 3, traps: Mapping[str, Sequence[str]] | None = None) -> Column:
    """`weight` for each hit in the title, one for any in the body (or its first `head` characters), summed over terms."""
    p = Phrases(terms, traps)

    @F.arrow_udf("int")
    def add(titles: pa.Array, bodies: pa.Array) -> pa.Array:
        return mapped(lambda t, b: weight * sum(p.counts(t).values()) + len(p.counts(b)), pa.int32(), titles, bodies)

    return add(title, F.substring(body, 1, head) if head else body)


def class_scores(
    docs: DataFrame, key: str, title: Column, field: Column, body: Column, lexicon: DataFrame, least: int = 3, weights: tuple[int, int, int] = (3, 3, 1),
    traps: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(key, code, score): classes (code, term) of a score of `least` or more.

    Each term of a class adds its hits in the title and in the field, times their weights, and once its weight for the
    body, however often it stands there. A term may be of several classes; a row of the lexicon that repeats counts once.
    No text leaves its row, so nothing is shuffled.
    """
    rows = lexicon.select(F.col(lexicon.columns[0]).cast("string").alias("code"), F.col(lexicon.columns[1]).alias("term")).where("code IS NOT NULL AND term <> ''").distinct()
    pairs = [(r["code"], r["term"]) for r in rows.limit(MOST + 1).collect()]
    if len(pairs) > MOST:
        raise ValueError(f"at most {MOST} phrases at a time")
    p = Phrases(sorted({t for _, t in pairs}), traps)
    of: dict[str, list[str]] = {}
    for code, term in pairs:
        of.setdefault(term, []).append(code)
    codes = [of[t] for t in p.terms]

    def score(title: str | None, field: str | None, body: str | None) -> list[dict]:
        out: dict[str, int] = {}
        for text, w, once in ((title, weights[0], False), (field, weights[1], False), (body, weights[2], True)):
            for i, n in p.counts(text).items():
                for code in codes[i]:
                    out[code] = out.get(code, 0) + w * (1 if once else n)
        return [{"code": c, "score": s} for c, s in sorted(out.items()) if s >= least]

    kind = pa.list_(pa.struct([("code", pa.string()), ("score", pa.int32())]))

    @F.arrow_udf("array<struct<code:string,score:int>>")
    def scored(titles: pa.Array, fields: pa.Array, bodies: pa.Array) -> pa.Array:
        return mapped(score, kind, titles, fields, bodies)

    return docs.select(key, F.explode(scored(title, field, body)).alias("_s")).select(key, "_s.*")
