"""Scaling of numeric columns to (x - centre) / spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col, number, numeric_columns
from rowmill.functions.quantiles import quantiles
from rowmill.operators.steps import Step, applies


def fit_scale(
    df: DataFrame,
    method: str = "standard",
    columns: list[str] | None = None,
    protect: list[str] | None = None,
) -> Step:
    """Centre and spread per column.  No spread counts as 1.

    ``standard``: mean and population deviation (also the default for unknown
    names); ``minmax``: minimum and range; ``robust``: median and IQR.
    """
    names = [c for c in (columns or numeric_columns(df)) if c not in (protect or [])]
    params: dict[str, list] = {}
    if method == "robust":
        for c, q in quantiles(df, {c: [0.25, 0.5, 0.75] for c in names}).items():
            params[c] = [q[0.5], None if q[0.25] is None else q[0.75] - q[0.25]]
    elif names:
        exprs = []
        for i, c in enumerate(names):
            x = number(df, c)
            pair = (F.min(x), F.max(x) - F.min(x)) if method == "minmax" else (F.avg(x), F.stddev_pop(x))
            exprs.append(F.struct(*pair).alias(f"p{i}"))
        row = df.agg(*exprs).first()
        params = {c: list(row[i]) for i, c in enumerate(names)}
    return Step("scale", {"method": method, "params": {c: [a, b or 1.0] for c, (a, b) in params.items()}})


@applies("scale")
def _scale(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    scaled = {
        c: ((number(df, c) - F.lit(a).cast("double")) / F.lit(b)).alias(c)
        for c, (a, b) in state["params"].items()
        if c in df.columns
    }
    return df.select(*[scaled.get(c, col(c)) for c in df.columns])
