"""Helpers for tables of vectors inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor empty nor holding null, NaN or infinite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def stacked(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of arrays as one float64 matrix, padded with zeros on the right."""
    rows = [np.asarray(r, np.float64) for r in column]
    width = width or max(map(len, rows), default=0)
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    out = np.zeros((len(rows), width))
    for o, r in zip(out, rows):
        o[: len(r)] = r
    return out


def unpack(column: pd.Series, width: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def widths(df: DataFrame, v: str) -> int:
    return df.agg(F.coalesce(F.max(F.size(v)), F.lit(0))).first()[0]
