"""Every query of the catalogue against DuckDB, over the smallest tables."""

import datetime

import duckdb
import pandas as pd
import pytest

from graphloom.plans import catalogue, sources  # noqa: F401
from graphloom.plans.lenses import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(pd.Timestamp(v)) if isinstance(v, (pd.Timestamp, datetime.datetime)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points_need_no_session():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
