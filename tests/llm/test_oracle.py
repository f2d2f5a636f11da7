"""Registered queries of the package against DuckDB on the same tables."""

import duckdb
import pytest

import corpus_pipeline
from rowmill.llm.catalog import ORACLES, QUERIES
from tests.test_oracle import TABLES, rows


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "best_fit_packing"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas().astype(object)
    want = duck.execute(ORACLES[name]).df().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    whole = lambda d: d.map(lambda v: int(v) if isinstance(v, float) and v.is_integer() else v)
    assert rows(whole(got)) == rows(whole(want.where(want.notna(), None)))
