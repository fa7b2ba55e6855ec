"""Every registered query outside the corpus subpackage against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pandas as pd
import pytest

from tagloom.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return str([cell(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (decimal.Decimal, int, float)) or (hasattr(x, "dtype") and not isinstance(x, pd.Timestamp)):
        return float(x)
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(x)
    return x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    """Their values are checked on hand-made cases in test_units."""
    one, two = (QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(one) and len(one.columns) == len(set(one.columns)) and rows(one) == rows(two)
