"""Regression metrics and residual statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import number
from rowmill.functions.quantiles import quantiles
from rowmill.functions.stats import ratio


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: errors, explained variance and actual/predicted moments."""
    y, p = number(df, actual), number(df, predicted)
    e = y - p
    median = quantiles(df, {"abs": [0.5]}, {"abs": F.abs(e)})["abs"][0.5]
    sums = df.agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(y).alias("vy"),
        F.var_pop(e).alias("ve"),
        F.max(F.abs(e)).alias("max_error"),
        F.min(F.abs(y)).alias("least"),
        F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))).alias("ape"),
        # NULL where the predictions or the values do not vary.
        F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p)).alias("pred_actual_correlation"),
    )
    mse = F.col("mse")
    return sums.select(
        (1 - ratio(mse, F.col("vy"))).alias("r2_score"),
        "mse",
        F.sqrt(mse).alias("rmse"),
        "mae",
        F.lit(median).cast("double").alias("median_ae"),
        (1 - ratio(F.col("ve"), F.col("vy"))).alias("explained_variance"),
        "max_error",
        F.when(F.col("least") > 0, F.col("ape") * 100).alias("mape"),
        "pred_actual_correlation",
    )


def residual_stats(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = number(df, actual) - number(df, predicted)
    q = quantiles(df, {"e": [0.25, 0.75]}, {"e": e})["e"]
    return df.agg(
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        F.lit(q[0.25]).cast("double").alias("q25"),
        F.lit(q[0.75]).cast("double").alias("q75"),
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum per column."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(number(df, c)).alias("mean"),
            F.stddev_pop(number(df, c)).alias("std"),
            F.min(number(df, c)).alias("min"),
            F.max(number(df, c)).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
