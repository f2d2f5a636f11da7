"""Quantiles, running totals, lookups and storage, on hard inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.functions import quantiles as Q
from rowmill.functions.columns import digest, families
from rowmill.functions.lookup import attach
from rowmill.functions.ordering import global_rank, running_totals
from rowmill.functions.storage import checkpoint_folder, settle

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def inputs():
    rng = np.random.default_rng(1)
    return {
        "uniform": rng.uniform(size=4000),
        "one_hot_value": np.where(rng.uniform(size=4000) < 0.6, 5.0, rng.normal(size=4000) * 10),
        "constant": np.full(300, 2.5),
        "two": np.array([1.0, 2.0]),
        "single": np.array([7.0]),
        "heavy_tail": np.exp(rng.normal(size=4000) * 8),
        "few_distinct": rng.integers(0, 4, 4000).astype(float),
    }


@pytest.mark.parametrize("limit", [200_000, 3])
def test_quantiles_are_exact(spark, monkeypatch, limit):
    """All inputs as columns of one table; short ones end in missing values."""
    monkeypatch.setattr(Q, "GATHER_ROWS", limit)
    columns = inputs()
    rows = [tuple(float(v[i]) if i < len(v) else None for v in columns.values()) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).coalesce(3)
    got = Q.quantiles(df, {c: PROBS for c in columns})
    for c, values in columns.items():
        for p in PROBS:
            assert got[c][p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_bad_sketch_still_gives_exact_quantiles(spark, monkeypatch):
    """The sketch only proposes; a wrong proposal is moved by the counts."""
    values = np.random.default_rng(2).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    real = Q._sketch

    def wrong(frame, exprs):
        return {k: (n, a, b, list(reversed(g))) for k, (n, a, b, g) in real(frame, exprs).items()}

    monkeypatch.setattr(Q, "_sketch", wrong)
    got = Q.quantiles(df, {"x": [0.1, 0.3]})["x"]
    assert got[0.1] == pytest.approx(np.quantile(values, 0.1))
    assert got[0.3] == pytest.approx(np.quantile(values, 0.3))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "x double, y double")
    got = Q.quantiles(df, {"x": [0.5], "y": [0.5]})
    assert got["x"][0.5] == 2.0
    assert got["y"][0.5] is None


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(3)
    # One key holds most rows, so it spans several ranges.
    rows = [("hot" if rng.uniform() < 0.7 else f"k{i % 5}", i, int(rng.integers(1, 9))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    got = running_totals(df, [F.col("i")], {"s": F.col("v")}, ["k"]).collect()
    seen = {}
    want = {}
    for k, i, v in rows:
        seen[k] = seen.get(k, 0) + v
        want[(k, i)] = seen[k]
    assert {(r["k"], r["i"]): r["s"] for r in got} == want


def test_global_rank_descending(spark):
    df = spark.range(1000).repartition(7)
    got = {r["id"]: r["at"] for r in global_rank(df, [F.desc("id")], "at").collect()}
    assert got == {i: 1000 - i for i in range(1000)}


@pytest.mark.parametrize("limit", [10**9, 0])
def test_attach_gives_the_same_rows_either_way(spark, limit):
    rows = [("hot", i) if i % 3 else (None if i % 7 == 0 else f"k{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(6)
    table = settle(df.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top")))
    got = attach(df, table, "k", ["top"], broadcast_bytes=limit, salts=4)
    tops = {}
    for k, i in rows:
        tops[k] = max(tops.get(k, 0), i)
    assert sorted((r["i"], r["top"]) for r in got.collect()) == sorted((i, tops[k]) for k, i in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)


def test_digest_keeps_equality(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long,), (long,), ("x" * 499,), ("short",)], "s string")
    assert df.select(digest(F.col("s"))).distinct().count() == 3


def test_families(spark):
    df = spark.sql("select 1 a, 1.5D b, cast(1 as decimal(4,1)) c, 'x' d, current_date() e, true f, array(1) g")
    got = families(df)
    assert got == {
        "numeric": ["a", "b", "c"], "categorical": ["d"], "datetime": ["e"], "boolean": ["f"], "other": ["g"],
    }


def test_settled_tables_live_in_the_checkpoint_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert not configured or checkpoint_folder(spark).startswith(configured)
    table = settle(spark.range(10))
    assert table.count() == 10 and checkpoint_folder(spark) in table.inputFiles()[0]
