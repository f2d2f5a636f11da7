"""Every registered query against DuckDB on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from rowmill.plans.catalog import ORACLES, QUERIES

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(v.item()) if hasattr(v, "item") else repr(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
