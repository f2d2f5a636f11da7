"""Univariate feature scores and k-best selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col, family, long_rows, number, present
from rowmill.functions.storage import settle
from rowmill.operators.steps import Step

# A target up to this many distinct values counts as classes;
# at most this many features are kept by default.
CLASS_LIMIT = 20
DEFAULT_BEST = 50


def _feature(df: DataFrame, name: str) -> Column:
    if family(df.schema[name].dataType) == "boolean":
        return col(name).cast("double")
    return number(df, name)


def _by_class(df: DataFrame, features: list[str], target: str, stats: dict) -> DataFrame:
    """``(column, class, n, stats...)``: one grouped aggregate for all
    features, reshaped to long rows only after it has shrunk to classes."""
    wide = df.groupBy(present(df, target).alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(*[f(_feature(df, c)).alias(k) for k, f in stats.items()]).alias(f"s{i}") for i, c in enumerate(features)],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(features)])
    return wide.select("class", "n", F.explode(rows).alias("r")).select("class", "n", "r.column", "r.s.*")


def anova_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F = between-class over within-class mean square, per feature.

    Class means and variances are merged, not raw squares, so large values do
    not cancel.
    """
    parts = settle(_by_class(df, features, target, {"m": F.avg, "v": F.var_pop}))
    # One row per feature, so the join back moves no class rows.
    overall = parts.groupBy("column").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("k"),
    )
    gap = F.col("m") - F.col("grand")
    sums = (
        parts.join(F.broadcast(overall), "column")
        .groupBy("column", "total", "k")
        .agg(F.sum(F.col("n") * gap * gap).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    )
    return sums.select(
        "column",
        F.when(
            (F.col("k") > 1) & (F.col("total") > F.col("k")) & (F.col("w") > 0),
            (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("total") - F.col("k"))),
        ).alias("score"),
    )


def chi2(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Sum of (observed - expected)^2 / expected, where *observed* is the sum
    of the feature within a class.  Negative values are an error."""
    parts = settle(_by_class(df, features, target, {"observed": F.sum, "low": F.min}))
    totals = parts.groupBy("column").agg(
        F.sum("observed").alias("all"), F.sum("n").alias("total"), F.min("low").alias("low")
    )
    expected = F.col("n") / F.col("total") * F.col("all")
    off = F.col("observed") - expected
    cells = parts.drop("low").join(F.broadcast(totals), "column")
    sums = cells.groupBy("column", "low").agg(F.sum(F.when(expected > 0, off * off / expected).otherwise(0.0)).alias("s"))
    checked = F.when(F.col("low") < 0, F.raise_error(F.lit("chi2 needs non-negative features"))).otherwise(F.col("s"))
    return sums.select("column", checked.cast("double").alias("score"))


def regression_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature."""
    y = number(df, target)
    wide = df.agg(
        F.count(y).alias("_n"), *[F.corr(_feature(df, c), y).alias(f"r_{c}") for c in features]
    )
    r2 = lambda c: col(f"r_{c}") * col(f"r_{c}")
    return long_rows(
        wide,
        features,
        {"score": lambda c: F.when(r2(c) < 1, r2(c) / (1 - r2(c)) * (F.col("_n") - 2)).otherwise(F.lit(float("inf")))},
    )


def is_class_target(df: DataFrame, target: str) -> bool:
    if family(df.schema[target].dataType) == "categorical":
        return True
    few = df.select(present(df, target).alias("y")).filter("y is not null").distinct().limit(CLASS_LIMIT + 1)
    return few.count() <= CLASS_LIMIT


def feature_scores(df: DataFrame, target: str, method: str = "auto", features: list[str] | None = None) -> DataFrame:
    """``(column, score)``: ANOVA F (or chi2) for class targets, else the
    regression F whatever method was asked."""
    features = features or [c for c in df.columns if c != target]
    if is_class_target(df, target):
        return chi2(df, features, target) if method == "chi2" else anova_f(df, features, target)
    return regression_f(df, features, target)


def fit_select(df: DataFrame, target: str | None, method: str = "auto", max_features: int | None = None) -> Step:
    """Keep the k best-scoring features in table order, then the target."""
    if not target or target not in df.columns:
        return Step("select", {"columns": df.columns, "scores": {}})
    features = [c for c in df.columns if c != target]
    k = min(DEFAULT_BEST, len(features) // 2) if max_features is None else max_features
    k = min(k, len(features))
    # One row per column of the table.
    scores = {r["column"]: r["score"] for r in feature_scores(df, target, method, features).collect()}
    ranked = sorted(
        range(len(features)),
        key=lambda i: (scores.get(features[i]) if scores.get(features[i]) is not None else float("-inf"), i),
    )
    best = [features[i] for i in sorted(ranked[len(features) - k :])]
    return Step("select", {"columns": best + [target], "scores": {c: scores.get(c) for c in best}})
