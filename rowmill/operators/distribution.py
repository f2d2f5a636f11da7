"""Distribution of actual against predicted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import long_rows, number
from rowmill.functions.quantiles import quantiles
from rowmill.operators.profile import value_counts
from rowmill.operators.regression import moments

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def numeric_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments and percentiles, one row per column."""
    q = quantiles(df, {c: list(PERCENTILES.values()) for c in columns})
    pick = {
        k: F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(q[c][p]).cast("double"))])
        for k, p in PERCENTILES.items()
    }
    return moments(df, columns).withColumns({k: m[F.col("column")] for k, m in pick.items()})


def categorical_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count, most and least frequent value (ties: the smallest)."""
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("most_frequent"),
            F.max("n").alias("most_count"),
            F.min_by("value", F.struct("n", "value")).alias("least_frequent"),
            F.min("n").alias("least_count"),
        )
    )


def prediction_uncertainty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and maximum of the deviation over the prediction columns."""
    wide = df.agg(*[F.stddev_pop(number(df, c)).alias(f"s_{c}") for c in columns])
    return long_rows(wide, columns, {"s": lambda c: F.col(f"s_{c}")}).agg(
        F.avg("s").alias("mean_std"), F.max("s").alias("max_std")
    )
