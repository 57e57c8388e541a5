"""Dates, arrays, JSON and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")


def any_date(x: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; else null."""
    return F.coalesce(*[F.try_to_date(F.substring(x, 1, 19) if "T" in f else x, f) for f in formats])


def days_since(d: Column, as_of: Column) -> Column:
    """Days from d to as_of, 0 at least; a missing date counts as today."""
    return F.coalesce(F.greatest(F.lit(0), F.datediff(as_of, d)), F.lit(0))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def scan_cutoff(high: Column, overlap_days: int, floor: Column) -> Column:
    """Where the next scan starts: an overlap before the high-water mark, never before the floor."""
    return F.greatest(F.coalesce(F.date_sub(high, overlap_days), floor), floor)


def json_array(x: Column) -> Column:
    """Decode a JSON array of strings; anything else is an empty array."""
    return F.coalesce(F.from_json(x, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def closed_set(x: Column, allowed: list[str], default: str) -> Column:
    """Trimmed lower-case members of a closed set, distinct, in order; the default if none is left."""
    low = F.transform(x, lambda v: F.lower(F.trim(v)))
    kept = F.array_distinct(F.filter(low, lambda v: v.isin(*allowed)))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array(F.lit(default)))


def embedded_json(x: Column) -> Column:
    """From the first brace to the last one, if that is an object."""
    body = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(F.json_object_keys(F.nullif(body, F.lit(""))).isNotNull(), body)


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x - y)


def distance(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd == 0, 0.0).otherwise((x - mean) / sd)
