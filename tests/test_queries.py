"""Every core query over the smallest tables: against its SQL in DuckDB, or that it runs."""

import math
import os

import pytest

from graphloom.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


#: The columns of a union schema depend on the data; its SQL names those of this table set.
ELSEWHERE = {"p1_entries": "/root/testdata/sf0.01"}


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def plain(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("nan", "NaT", "<NA>"):
            return None
        try:
            return round(float(x), 6)
        except (TypeError, ValueError):
            return str(x)

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    folder = ELSEWHERE.get(name, DATA)
    got, want = QUERIES[name](spark, folder).toPandas(), duck(folder).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(df.columns) > 1 and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
