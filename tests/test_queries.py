"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from statuta import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if "int" in type(v).__name__ or "float" in type(v).__name__:
            return repr(float(v))
        return str(pd.Timestamp(v)) if type(v).__name__ in ("date", "Timestamp", "datetime") else str(v)

    out = df[sorted(df.columns)].map(one)
    return out.sort_values(list(out.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = plain(QUERIES[name](spark, FOLDER).toPandas()), plain(duck.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def test_names_of_sql_are_queries():
    assert set(SQL) <= set(QUERIES)
