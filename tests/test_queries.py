"""Every registered query of the engine against its SQL, answered by DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from lattisca.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0 and v.dtype.kind in "iuf":
        return f"{float(v):.9g}"
    return str(v)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(v) for v in r) for r in df[names].itertuples(index=False)), key=str)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
