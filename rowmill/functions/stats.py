"""Small aggregate expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b`` that gives ``empty`` instead of an error when b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def skew_g1(x: Column) -> Column:
    """Bias-corrected sample skewness: NULL below 3 values, 0 for constants."""
    n = F.count(x).cast("double")
    spread = F.var_pop(x)
    g1 = F.when(spread > 0, F.skewness(x)).otherwise(F.lit(0.0))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
