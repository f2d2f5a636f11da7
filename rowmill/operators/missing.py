"""Dropping sparse columns and filling missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    categorical_columns,
    col,
    is_missing,
    number,
    numeric_columns,
    present,
)
from rowmill.functions.quantiles import quantiles
from rowmill.operators.profile import modes, value_counts
from rowmill.operators.steps import Step, applies

# Limits of the automatic strategy and the fallback fill.
AUTO_MEAN_BELOW, AUTO_MEDIAN_BELOW = 0.1, 0.3
NO_MODE_FILL = "Unknown"


def missing_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(is_missing(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def fit_drop_sparse(df: DataFrame, threshold: float = 0.5, protect: list[str] | None = None) -> Step:
    """Columns whose missing share is strictly above ``threshold``."""
    shares = missing_shares(df, [c for c in df.columns if c not in (protect or [])])
    return Step("drop_columns", {"columns": [c for c, s in shares.items() if s > threshold]})


def choose_numeric_fill(strategy: str, share: float) -> str:
    """The statistic that fills a column.

    ``auto`` goes by missing share.  Its last level stands for a nearest-
    neighbour fill on a lone column, where no distance exists and the column
    mean is used.  ``constant`` is the fill with 0.
    """
    if strategy == "auto":
        return "median" if AUTO_MEAN_BELOW <= share < AUTO_MEDIAN_BELOW else "mean"
    return strategy if strategy in ("mean", "constant") else "median"


def fit_impute(
    df: DataFrame,
    strategy: str = "auto",
    columns: list[str] | None = None,
    protect: list[str] | None = None,
) -> Step:
    """Fill values per column: mean / median / 0 for numbers, mode for strings."""
    wanted = [c for c in (columns or df.columns) if c not in (protect or [])]
    numbers = [c for c in numeric_columns(df) if c in wanted]
    strings = [c for c in categorical_columns(df) if c in wanted]
    shares = missing_shares(df, numbers)
    plan = {c: choose_numeric_fill(strategy, shares[c]) for c in numbers}
    fills: dict[str, float | str | None] = {c: 0.0 for c in numbers if plan[c] == "constant"}
    means = [c for c in numbers if plan[c] == "mean"]
    if means:
        row = df.agg(*[F.avg(number(df, c)).alias(f"a{i}") for i, c in enumerate(means)]).first()
        fills.update(zip(means, row))
    medians = {c: [0.5] for c in numbers if plan[c] == "median"}
    fills.update({c: q[0.5] for c, q in quantiles(df, medians).items()})
    if strings:
        fills.update({c: NO_MODE_FILL for c in strings})
        found = modes(value_counts(df, strings)).select("column", "mode").collect()  # a row per column
        fills.update({r["column"]: r["mode"] for r in found})
    return Step("impute", {"numeric": {c: fills[c] for c in numbers}, "strings": {c: fills[c] for c in strings}})


@applies("impute")
def _impute(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    filled = {
        c: F.coalesce(number(df, c), F.lit(v).cast("double"))
        for c, v in state["numeric"].items()
        if c in df.columns
    }
    filled.update(
        {c: F.coalesce(present(df, c), F.lit(v)) for c, v in state["strings"].items() if c in df.columns}
    )
    return df.select(*[filled[c].alias(c) if c in filled else col(c) for c in df.columns])


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Keep rows with a target; an absent, empty or all-missing one is an error."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    if len(df.columns) < 2:
        raise ValueError("Features or target data is empty")
    known = df.filter(~is_missing(df, target))
    if known.isEmpty():
        if df.isEmpty():
            raise ValueError("Features or target data is empty")
        raise ValueError("Target variable contains only missing values")
    return known
