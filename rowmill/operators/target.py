"""Target column analysis: distribution, balance and problem type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col, family, is_missing, number, present
from rowmill.functions.quantiles import quantiles
from rowmill.functions.stats import ratio, skew_g1

# Imbalance levels and problem-type limits.
HIGHLY, MODERATELY, SLIGHTLY = 10.0, 3.0, 1.5
MULTICLASS_LIMIT = 20
CONTINUOUS_SHARE = 0.9


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class, n)`` over the non-missing target values."""
    return (
        df.select(present(df, target).alias("class"))
        .filter("class is not null")
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_proportions(df: DataFrame, target: str) -> DataFrame:
    classes = class_distribution(df, target)
    total = classes.agg(F.sum("n").alias("total"))
    return classes.select("class", "n", (F.col("n") / total.scalar()).alias("proportion"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """One row: imbalance ratio, status, smallest and largest class."""
    sizes = class_distribution(df, target).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("minority_size"),
        F.max("n").alias("majority_size"),
    )
    r = F.col("majority_size") / F.col("minority_size")
    status = (
        F.when(r > HIGHLY, "highly_imbalanced")
        .when(r > MODERATELY, "moderately_imbalanced")
        .when(r > SLIGHTLY, "slightly_imbalanced")
        .otherwise("balanced")
    )
    return sizes.select("n_classes", "minority_size", "majority_size", r.alias("imbalance_ratio"), status.alias("status"))


def _distinct(df: DataFrame, target: str) -> DataFrame:
    """Rows, missing and distinct values; one shuffle of distinct values."""
    return (
        df.select(present(df, target).alias("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("v").alias("n_distinct"),
        )
    )


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row naming the learning task the target suggests."""
    facts = _distinct(df, target)
    k = F.col("n_distinct")
    if family(df.schema[target].dataType) in ("categorical", "boolean"):
        kind = (
            F.when(k == 2, "binary_classification")
            .when(k <= MULTICLASS_LIMIT, "multiclass_classification")
            .otherwise("high_cardinality_classification")
        )
    else:
        kind = F.when(ratio(k, F.col("n_rows"), 0.0) > CONTINUOUS_SHARE, "regression").otherwise(
            "discrete_regression"
        )
    return facts.select(F.lit(target).alias("target"), "n_rows", "n_distinct", kind.alias("problem_type"))


def target_report(df: DataFrame, target: str) -> DataFrame:
    """One row: distinct, missing and, for numbers, the usual moments."""
    facts = _distinct(df, target).select(
        F.lit(target).alias("target"),
        "n_distinct",
        "missing",
        ratio(F.col("missing") * 100.0, F.col("n_rows"), 0.0).alias("missing_pct"),
    )
    if family(df.schema[target].dataType) != "numeric":
        return facts
    median = quantiles(df, {target: [0.5]})[target][0.5]
    x = number(df, target)
    moments = df.agg(
        F.struct(
            F.avg(x).alias("mean"),
            F.lit(median).cast("double").alias("median"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            skew_g1(x).alias("skewness"),
        ).alias("s")
    )
    return facts.withColumn("s", moments.scalar()).select("*", "s.*").drop("s")
