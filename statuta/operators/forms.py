"""Forms: audience funnel by three lexicons, reference extraction, saving with reset of conclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import phrases

SURE, HEAD = 3, 1800


def points(title: Column, body: Column, terms: list[str]) -> Column:
    """Three for each hit in the title, one for any in the head of the body, summed over terms; all terms in one pass."""
    return phrases.points(title, body, terms, HEAD)


def kind_of_paper(title: Column, kinds: list[str]) -> Column:
    """The longest kind that the title starts with, after a leading word for form."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"^mẫu[ :]\s*", "")
    return F.coalesce(*[F.when(t.startswith(k), F.lit(k)) for k in sorted(kinds, key=lambda k: (-len(k), k))])


def audience(state: Column, business: Column, person: Column, kind: Column, veto: list[str], personal: list[str]) -> Column:
    """Struct (audience, is_business, is_individual); nulls are undecided.

    Business and person don't exclude each other, signs of the state exclude both. A kind of paper
    that organisations issue is never personal; one that only persons fill in is, if nothing
    points to business.
    """
    state_only = (state >= SURE) & (business == 0) & (person == 0)
    murky = state > 0
    for_business = business >= SURE
    vetoed, own = F.coalesce(kind.isin(*veto), F.lit(False)), F.coalesce(kind.isin(*personal), F.lit(False))
    for_person = ((person >= SURE) & ~vetoed) | (own & (business == 0))
    decided = ~murky & (for_business | for_person)
    who = F.when(state_only, "co_quan_nha_nuoc").when(decided, F.when(business >= person, "doanh_nghiep").otherwise("ca_nhan"))
    flag = lambda c: F.when(state_only, False).when(decided, c)
    return F.struct(who.alias("audience"), flag(for_business).alias("is_business"), flag(for_person).alias("is_individual"))


def body_references(body: Column, most: int = 8, head: int = 4000) -> Column:
    """The first distinct numbers of strict shape in the head of a body: a running number, a year of this or the last
    century and two to fifteen capitals, digits and hyphens. Telephone, tax and account numbers are none."""
    found = F.regexp_extract_all(F.substring(F.coalesce(body, F.lit("")), 1, head), F.lit(r"(?U)\b\d{1,4}[A-ZĐ]?/(?:19|20)\d{2}/[A-ZĐ][A-ZĐ0-9\-]{1,14}\b"), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


def saved(current: DataFrame, incoming: DataFrame, key: str, body: str) -> DataFrame:
    """Forms after a crawl: a changed body clears the conclusions (audience), an unchanged one keeps them."""
    i = incoming.withColumn("body_hash", F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    old = current.select(F.col(key).alias("_k"), F.col("body_hash").alias("_h"), F.col("audience").alias("_a"))
    j = i.join(old, i[key] == old["_k"], "left")
    return j.withColumn("audience", F.when(F.col("_h").eqNullSafe(F.col("body_hash")), F.col("_a"))).withColumn("is_new", F.col("_k").isNull()).drop("_k", "_h", "_a")
