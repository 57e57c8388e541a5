"""All registered queries of the reference operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> function of (spark, sf_dir)) and SQL (name -> text).
MODULES: list[str] = [f"statuta.plans.{m}" for m in ("rankings", "joining", "aggregating", "texts", "scoring", "assembling", "records", "further", "streams")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(name).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for name in MODULES:
        out |= import_module(name).SQL
    return out
