"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quillon.queries import ORACLES, QUERIES
from quillon.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT:
        return None
    if getattr(x, "ndim", 0) or isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    x = x.item() if hasattr(x, "item") else x
    return None if x is pd.NA else x


def rows(df, cols):
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike(spark, name):
    """Queries without SQL: they have rows, none of them blank, and a second run has the same."""
    first = QUERIES[name](spark, SF).toPandas()
    assert len(first) and not first.isna().all(axis=1).any()
    again = QUERIES[name](spark, SF).toPandas()
    assert sorted(map(repr, first.itertuples(index=False))) == sorted(map(repr, again.itertuples(index=False)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
