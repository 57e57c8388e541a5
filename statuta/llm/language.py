"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores its log frequency in every language. An unseen word backs off: if the table
of 4-grams holds any of its 4-grams, their mean log frequency counts; else 3-grams, and so on
down to single characters. A text's language has the largest sum; the score is its share of the
likelihoods (softmax), from 0 to 1.

The model is fitted on labelled documents: at most about `rows_per_language` of each of the
`languages` commonest languages and about `rows` over all of them, drawn by a hash of doc_id; rarer
languages are taken whole. A term is known if it occurs `least` times in that sample. These bounds
of the sample bound the tables; every document is judged, by its whole text.

Ties: of languages with equal sums the first by code point is told. A text of any length is one
bag of words.

Nulls: a null or letterless text is `und` with score 0, and so is every text if nothing was
learned; rows of null lang or doc_id are not learned from; a null doc_id counts as not held out.
Repeated rows are predicted alike and all returned. Empty tables give empty results. Columns other
than doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import fresh, give_back, small, written, written_by_batches

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: N-gram lengths from the longest, added count, words that a task holds, texts judged at a time.
LENGTHS, ADDED, HELD, BAGS = (4, 3, 2, 1), 0.5, 100_000, 250


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: a quarter, by a checksum of the id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams_of(word: str, n: int) -> list[str]:
    """N-grams of a word with its ends marked; the word itself for n = 0."""
    if not n:
        return [word]
    edged = f"<{word}>" if n > 1 else word
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def hashes_of(n: int, terms: list[str]) -> np.ndarray:
    """64-bit numbers of terms, one function for each n."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t, n) for t in terms), np.uint64, len(terms))


def count_terms(rows: DataFrame) -> DataFrame:
    """(n, term, lang, count): hashed words (n = 0) and n-grams of the given (lang, text) rows; languages are numbers."""

    def flush(held: dict[int, Counter]) -> Iterator[pd.DataFrame]:
        for lang, words in held.items():
            for n in (0, *LENGTHS):
                terms: Counter = Counter()
                for w, c in words.items():
                    for g in grams_of(w, n):
                        terms[g] += c
                if terms:
                    yield pd.DataFrame({"n": n, "term": hashes_of(n, list(terms)).view(np.int64), "lang": lang, "count": list(terms.values())})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                held.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
                if sum(map(len, held.values())) > HELD:
                    yield from flush(held)
                    held = {}
        yield from flush(held)
        held = {}
        give_back()

    counted = rows.select("lang", "text").mapInPandas(count, "n int, term long, lang int, count long")
    return counted.groupBy("n", "term", "lang").agg(F.sum("count").alias("count"))


class Model:
    """Log frequencies: for words and for each n a sorted array of terms and a line of scores for each.

    counts gives terms (hashed), numbers of languages and counts for one n, totals the sum of counts for an n and a language.
    """

    def __init__(self, languages: list[str], counts: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]], totals: dict[tuple[int, int], int]) -> None:
        self.languages = languages
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in (0, *LENGTHS):
            term, lang, count = counts(n)
            terms, line = np.unique(term.view(np.uint64), return_inverse=True)
            m = np.full((len(terms), len(languages)), ADDED)
            np.add.at(m, (line, lang), count)
            whole = np.array([totals.get((n, i), 0) + ADDED * (len(terms) + 1) for i in range(len(languages))])
            self.tables[n] = terms, np.log(m / whole)

    def scores(self, words: list[str]) -> np.ndarray:
        """A line of scores for each word: its own if it is known, else the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        left = np.arange(len(words))
        for n in (0, *LENGTHS):
            terms, lines = self.tables[n]
            if not len(left) or not len(terms):
                continue
            grams = [grams_of(words[i], n) for i in left.tolist()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            h = hashes_of(n, [g for gs in grams for g in gs])
            at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            known = terms[at] == h
            word = np.repeat(np.arange(len(left)), sizes)[known]
            found = np.bincount(word, minlength=len(left))
            some = np.flatnonzero(found)
            if len(some):
                starts = np.searchsorted(word, some)
                out[left[some]] = np.add.reduceat(lines[at[known]], starts, axis=0) / found[some, None]
            left = left[found == 0]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        bags = [Counter(WORD.findall(t.lower())) if t else Counter() for t in texts]
        places = {w: i for i, w in enumerate(dict.fromkeys(w for b in bags for w in b))}
        lines = self.scores(list(places))
        out = []
        for bag in bags:
            if not self.languages or not any(c.isalpha() for w in bag for c in w):
                out.append((UNKNOWN, 0.0))
                continue
            s = np.fromiter(bag.values(), np.float64, len(bag)) @ lines[[places[w] for w in bag]]
            p = np.exp(s - s.max())
            out.append((self.languages[int(np.argmax(s))], float(p.max() / p.sum())))
        return out


def fit(docs: DataFrame, rows_per_language: int = 8000, languages: int = 1000, rows: int = 64_000, least: int = 2) -> Model:
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    top = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).toPandas()  # at most `languages` rows
    names = sorted(top["lang"])
    if not names:
        return Model([], lambda n: (np.zeros(0, np.int64),) * 3, {})
    most = max(1, min(rows_per_language, rows // len(names)))
    shares = docs.sparkSession.createDataFrame([(x, names.index(x), max(1, int(n) // most)) for x, n in zip(top["lang"], top["n"])], "name string, number int, one_in long")
    drawn = labelled.join(F.broadcast(shares), F.col("lang") == F.col("name")).select("doc_id", "text", F.col("number").alias("lang"), "one_in").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), "one_in") == 0)
    counts = written_by_batches(count_terms(drawn), "language-counts")
    totals = {(r["n"], r["lang"]): r["s"] for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("s")).collect()}
    often = counts.groupBy("n", "term").agg(F.sum("count").alias("all")).where(F.col("all") >= least).drop("all")
    kept = written(counts.join(often, ["n", "term"]), "language-kept")

    def of(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = kept.where(F.col("n") == n).select("term", "lang", "count").toArrow()  # at most the terms of `rows` texts
        return tuple(c.to_numpy() for c in columns.columns)

    return Model(names, of, totals)


def told(docs: DataFrame, text: str, **bounds: int) -> Column:
    """The struct (lang_pred, score) of a text column, by a model fitted on docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **bounds))
    give_back()

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [pd.DataFrame(model.value.predict(list(texts[i : i + BAGS])), columns=["lang_pred", "score"]) for i in range(0, len(texts), BAGS)]
            yield pd.concat(parts, ignore_index=True)
        give_back()

    return predict(text)


def predicted(docs: DataFrame, *columns: str, **bounds: int) -> DataFrame:
    """The named columns of docs with held_out, lang_pred and score, as a written table."""
    rows = docs.select(fresh(docs).alias("doc")).withColumn("told", told(docs, "doc.text", **bounds))
    rows = rows.select(*[F.col(f"doc.`{c}`") for c in columns], held_out(F.col("doc.doc_id")).alias("held_out"), "told.lang_pred", "told.score")
    return written_by_batches(rows, "language-told")


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a score of at least `least`, columns as given."""
    key = F.xxhash64("text")
    rows = docs.select("doc_id", key.alias("key"), told(docs, "text").alias("told"))
    lost = rows.where((F.col("told.lang_pred") == UNKNOWN) | (F.col("told.score") < least)).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    # Equal texts are judged alike, so a row is known by its doc_id and text.
    lost = small(written_by_batches(lost, "language-lost").distinct())
    rows = docs.select(fresh(docs).alias("doc"), key.alias("key"))
    return rows.join(lost, F.col("doc.doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left_anti").select("doc.*")
