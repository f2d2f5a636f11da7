"""Engineered columns: powers, products, logs and equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import number, numeric_columns
from rowmill.operators.steps import Step, applies

# How many columns the generators look at, and their defaults.
POLYNOMIAL_COLUMNS, SQUARE_COLUMNS = 5, 3
DEFAULT_DEGREE, DEFAULT_INTERACTIONS, DEFAULT_BINS = 2, 10, 5


def _pairs(columns: list[str], limit: int) -> list[tuple[str, str]]:
    every = ((a, b) for i, a in enumerate(columns) for b in columns[i + 1 :])
    return [p for p, _ in zip(every, range(limit))]


def fit_features(
    df: DataFrame, config: dict, columns: list[str] | None = None, protect: list[str] | None = None
) -> Step:
    """Decide the new columns; only logs and bins need a scan (min / max)."""
    base = [c for c in (columns or numeric_columns(df)) if c not in (protect or [])]
    new: list[dict] = []
    if config.get("polynomial_features"):
        degree = config.get("polynomial_degree", DEFAULT_DEGREE)
        for c in base[:POLYNOMIAL_COLUMNS]:
            for d in range(2, degree + 1):
                new.append({"name": f"{c}_poly_{d}", "kind": "polynomial", "of": [c], "power": d})
    if config.get("squares"):
        for c in base[:SQUARE_COLUMNS]:
            new.append({"name": f"{c}_squared", "kind": "polynomial", "of": [c], "power": 2})
    if config.get("interaction_features"):
        for a, b in _pairs(base, config.get("max_interactions", DEFAULT_INTERACTIONS)):
            new.append({"name": f"{a}_x_{b}", "kind": "interaction", "of": [a, b]})
    needs_range = config.get("log_transform") or config.get("binning")
    if needs_range and base:
        row = df.agg(
            *[F.struct(F.min(number(df, c)), F.max(number(df, c))).alias(f"r{i}") for i, c in enumerate(base)]
        ).first()
        spans = {c: tuple(row[i]) for i, c in enumerate(base)}
        if config.get("log_transform"):
            for c in base:
                if spans[c][0] is not None and spans[c][0] > 0:
                    new.append({"name": f"{c}_log", "kind": "log_transform", "of": [c]})
        if config.get("binning"):
            bins = config.get("n_bins", DEFAULT_BINS)
            for c in base:
                new.append(
                    {"name": f"{c}_binned", "kind": "binned", "of": [c], "bins": bins, "span": list(spans[c])}
                )
    return Step("features", {"new": new})


def _bin(x: Column, low: float | None, high: float | None, bins: int) -> Column:
    """0-based right-closed bin: how many inner edges lie below the value.

    A constant column falls in the middle bin of a range widened around it.
    """
    if low is None:
        return F.lit(None).cast("int")
    if low == high:
        code = F.lit((bins - 1) // 2)
    else:
        step = (high - low) / bins
        code = F.lit(0)
        for i in range(1, bins):
            code = code + (x > F.lit(low + i * step)).cast("int")
    return F.when(x.isNotNull(), code)


@applies("features")
def _features(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    made = []
    for f in state["new"]:
        x = number(df, f["of"][0])
        if f["kind"] == "polynomial":
            value = F.pow(x, F.lit(float(f["power"])))
        elif f["kind"] == "interaction":
            value = x * number(df, f["of"][1])
        elif f["kind"] == "log_transform":
            value = F.log1p(x)
        else:
            value = _bin(x, *f["span"], f["bins"])
        made.append(value.alias(f["name"]))
    return df.select("*", *made)


def fit_squares(df: DataFrame, config: dict, protect: list[str] | None = None) -> Step:
    """The short form: squares of three columns and the first product."""
    small = {
        "squares": config.get("polynomial_features"),
        "interaction_features": config.get("interaction_features"),
        "max_interactions": 1,
    }
    return fit_features(df, small, protect=protect)

