"""The automaton against one pass of a regular expression a term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from statuta.functions import phrases, text
from statuta.operators import forms


def slow(term, low, traps):
    n = len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", low))
    return max(0, n - sum(low.count(x) for x in traps.get(term, ())))


WORDS = ["điện", "bưu", "nước", "nhà", "x", "a", "b", "a_b", "phải", "bên", "12", "Ế", "cấm", "nghiêm"]
TERMS = ["điện", "nước", "phải", "a", "b", "a b", "a b a", "b a", "x x", "12", "cấm", "nghiêm cấm", "ế", "a-b"]
HERE = {**text.TRAPS, "a": ("a b", "x a"), "x x": ("x",)}


def sentences(seed, n):
    rng = random.Random(seed)
    return ["".join(w + rng.choice([" ", " ", "  ", "-", ",", ""]) for w in rng.choices(WORDS, k=rng.randrange(30))) for _ in range(n)]


def test_counts_equal_regular_expressions():
    p = phrases.Phrases(TERMS, HERE)
    for s in sentences(1, 3000):
        want = {i: n for i, t in enumerate(p.terms) if (n := slow(t, s.lower(), HERE))}
        assert p.counts(s) == want
    assert p.counts(None) == p.counts("") == phrases.Phrases([]).counts("a") == {}


def test_columns_equal_the_slow_way(spark):
    rows = [(i, s) for i, s in enumerate(sentences(2, 200))] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = df.select("id", phrases.phrase_counts(F.col("text"), TERMS, HERE).alias("c"), phrases.weighted_total(F.col("text")).alias("w"), forms.points(F.col("text"), F.col("text"), ["a", "điện", "a b"]).alias("p")).collect()
    for r in got:
        low = (dict(rows)[r["id"]] or "").lower()
        assert {x["term"]: x["n"] for x in r["c"]} == {t: n for t in TERMS if (n := slow(t, low, HERE))}
        count = lambda t: slow(t, low, text.TRAPS)
        assert r["w"] == sum(max(0, count(t) - sum(map(count, text.HELD_BY.get(t, ())))) * w for t, w in text.RESTRICTIONS.items())
        assert r["p"] == sum(3 * count(t) + min(1, count(t)) for t in ("a", "điện", "a b"))


def test_scores_of_hundreds_of_phrases(spark):
    """Title and field three a hit, the body one a term, classes from three on; a phrase may be of two classes."""
    rng = random.Random(4)
    lexicon = [(f"N{rng.randrange(25)}", " ".join(rng.choices([w.lower() for w in WORDS], k=rng.randrange(1, 4)))) for _ in range(600)]
    s = sentences(5, 90)
    docs = [(i, s[i], s[i + 30] if i % 4 else None, s[i + 60] * 3) for i in range(30)]
    df = spark.createDataFrame(docs, "id int, title string, field string, body string")
    table = spark.createDataFrame([*lexicon, lexicon[0], (None, "a"), ("N1", ""), ("N1", None)], "code string, term string")
    got = {(r["id"], r["code"]): r["score"] for r in phrases.class_scores(df, "id", F.col("title"), F.col("field"), F.col("body"), table).collect()}
    want = {}
    for i, title, field, body in docs:
        for code, term in set(lexicon):
            count = [slow(term, (x or "").lower(), text.TRAPS) for x in (title, field, body)]
            want[i, code] = want.get((i, code), 0) + 3 * count[0] + 3 * count[1] + min(1, count[2])
    assert got == {k: n for k, n in want.items() if n >= 3} and len(got) > 100


def test_lexicon_is_bounded(monkeypatch):
    monkeypatch.setattr(phrases, "MOST", 3)
    with pytest.raises(ValueError, match="at most 3"):
        phrases.Phrases("abcd")
