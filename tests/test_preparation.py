"""Preparation steps on edge tables, and the fitted chain."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rowmill.operators import missing as M
from rowmill.operators import profile as P
from rowmill.operators import select as S
from rowmill.operators import target as T
from rowmill.operators.encode import fit_encode
from rowmill.operators.features import fit_features
from rowmill.operators.outliers import fit_outliers
from rowmill.operators.scale import fit_scale
from rowmill.operators.split import with_split
from rowmill.operators.steps import Chain
from rowmill.plans.prepare import prepare

NAN = float("nan")


def test_null_and_nan_are_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (3.0,)], "x double")
    assert P.missing_report(df).first()["missing"] == 2
    filled = M.fit_impute(df, "mean").transform(df)
    assert sorted(r[0] for r in filled.collect()) == [1.0, 2.0, 2.0, 3.0]


def test_all_missing_columns(spark):
    df = spark.createDataFrame([(None, None)] * 3, "x double, s string")
    step = M.fit_impute(df, "median")
    assert step.state == {"numeric": {"x": None}, "strings": {"s": "Unknown"}}
    row = P.numeric_profile(df, ["x"]).first()
    assert row["count"] == 0 and row["median"] is None and row["missing"] == 3


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    assert M.fit_impute(df).state["strings"]["s"] == "a"


def test_drop_sparse_is_strict(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1, None)], "a int, half int, all int")
    assert M.fit_drop_sparse(df, 0.5).state["columns"] == ["all"]


@pytest.mark.parametrize("share, want", [(0.05, "mean"), (0.1, "median"), (0.29, "median"), (0.3, "mean")])
def test_auto_fill_levels(share, want):
    assert M.choose_numeric_fill("auto", share) == want


def test_target_errors(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, y string")
    with pytest.raises(ValueError, match="not found"):
        M.drop_missing_target(df, "z")
    with pytest.raises(ValueError, match="only missing"):
        M.drop_missing_target(df, "y")
    with pytest.raises(ValueError, match="empty"):
        M.drop_missing_target(df.limit(0), "y")


def test_outlier_limits_follow_the_previous_column(spark):
    rows = [(float(i), float(i % 10)) for i in range(100)] + [(1000.0, 500.0), (50.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = fit_outliers(df).transform(df).collect()
    assert len(kept) == 100 and max(r["a"] for r in kept) == 99


def test_zscore_without_spread_keeps_nothing(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "a double")
    assert fit_outliers(df, "zscore").transform(df).count() == 0


def test_bins_put_the_minimum_first_and_close_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2, 2.1, 4, 10)] + [(None,)], "x double")
    made = fit_features(df, {"binning": True}).transform(df)
    assert [r["x_binned"] for r in made.collect()] == [0, 0, 1, 1, 4, None]


def test_log_only_for_positive_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 3.0)], "a double, b double")
    made = fit_features(df, {"log_transform": True}).transform(df)
    assert made.columns == ["a", "b", "a_log"]
    assert made.first()["a_log"] == pytest.approx(math.log(2))


def test_interactions_are_limited(spark):
    df = spark.createDataFrame([tuple(range(6))], "a int, b int, c int, d int, e int, f int")
    made = fit_features(df, {"interaction_features": True}).transform(df)
    assert len(made.columns) == 16 and "a_x_b" in made.columns


def test_one_hot_missing_is_all_false(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    made = fit_encode(df, "onehot").transform(df)
    assert made.columns == ["s_b"] and [r[0] for r in made.collect()] == [False, True, False]


def test_codes_of_unseen_values_are_empty(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    step = fit_encode(train, "label")
    got = {r["k"]: r["s_encoded"] for r in step.transform(
        spark.createDataFrame([("b", 1), ("zz", 2), (None, 3)], "s string, k int")).collect()}
    assert got == {1: 1, 2: None, 3: 2}


def test_too_many_indicator_columns_is_an_error(spark):
    df = spark.range(2100).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="too many"):
        fit_encode(df, "onehot")


def test_auto_uses_codes_for_a_class_target(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("s"), F.lit("y").alias("t"))
    assert fit_encode(df, "auto", "t").state["plan"][0]["method"] == "label"


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "unheard_of"])
def test_constant_columns_scale_to_zero(spark, method):
    df = spark.createDataFrame([(4.0,)] * 3, "x double")
    assert {r[0] for r in fit_scale(df, method).transform(df).collect()} == {0.0}


def test_chi2_refuses_negative_values(spark):
    df = spark.createDataFrame([(-1.0, "a"), (2.0, "b")], "x double, y string")
    with pytest.raises(PySparkException):
        S.chi2(df, ["x"], "y").collect()


@pytest.mark.parametrize("parts", [1, 9])
def test_split_ignores_partitioning(spark, parts):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y")).repartition(parts)
    test = {r["id"] for r in with_split(df, "id", "y").filter("split = 'test'").collect()}
    again = {r["id"] for r in with_split(df.repartition(4), "id", "y").filter("split = 'test'").collect()}
    assert len(test) == 200 and test == again


def test_split_quota_per_class(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("rare").alias("y"))
    got = {r["y"]: r["count"] for r in with_split(df, "id", "y").filter("split = 'test'").groupBy("y").count().collect()}
    assert got == {"hot": 180, "rare": 20}


def test_many_classes_fall_back_to_one_quota(spark):
    df = spark.range(50).select("id", F.col("id").alias("y"))
    assert with_split(df, "id", "y").filter("split = 'test'").count() == 10


def test_class_balance_levels(spark):
    for big, want in ((10, "balanced"), (20, "slightly_imbalanced"), (40, "moderately_imbalanced"), (200, "highly_imbalanced")):
        df = spark.range(10 + big).select(F.when(F.col("id") < 10, "a").otherwise("b").alias("y"))
        assert T.class_balance(df, "y").first()["status"] == want


def test_quality_of_a_clean_table(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"))
    row = P.quality(df).first()
    assert row["quality_score"] == 100 and row["issues"] == ""


def test_correlation_matches_builtin(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {(r["a"], r["b"]): r["corr"] for r in P.correlation(df).collect()}
    want = df.agg(F.corr("l_quantity", "l_extendedprice")).first()[0]
    assert got[("l_quantity", "l_extendedprice")] == pytest.approx(want, abs=1e-12)


def test_chain_reloads_with_its_tables(spark, tmp_path):
    rows = [(float(i), f"c{i % 12}", "x" if i % 2 else "y", float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, many string, few string, t double")
    fitted = prepare(df, {"target_column": "t", "remove_duplicates": False})
    fitted.chain.save(spark, str(tmp_path / "chain"))
    again = Chain.load(spark, str(tmp_path / "chain")).transform(df)
    assert again.columns == fitted.table.columns
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, fitted.table.collect()))
    assert {r["step"] for r in fitted.chain.parameters(spark).collect()} >= {"impute", "encode", "scale"}


def test_top_values_limits_each_task_first(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("s"))
    plan = P.top_values(P.value_counts(df, ["s"]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_split_refuses_missing_keys(spark):
    df = spark.createDataFrame([(i if i % 20 else None, float(i)) for i in range(100)], "k int, x double")
    with pytest.raises(ValueError, match="5 rows"):
        with_split(df, "k")


def test_correlation_in_blocks_equals_one_scan(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7)) * [1, 1e3, 1, 1, 1, 1, 1] + [0, 1e6, 0, 0, 0, 0, 0]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=60) / 10
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5], x[:, 6] = 4.0, np.nan  # constant, all missing
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(7)]))
    want = pd.DataFrame(x).corr()
    for block in (3, 7, 100):
        got = {(r["a"], r["b"]): r["corr"] for r in P.correlation(df, block=block).collect()}
        assert len(got) == 28
        for (a, b), c in got.items():
            w = want.iloc[int(a[1:]), int(b[1:])]
            assert c is None if np.isnan(w) else c == pytest.approx(w, abs=1e-9), (a, b)
    assert P.correlation(df.limit(0), block=3).filter("corr is not null").count() == 0
    assert P.correlation(spark.createDataFrame([("x",)], "s string")).count() == 0
