"""Categorical encoders: indicator columns, sorted codes, target means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import categorical_columns, col, family, number, present
from rowmill.functions.lookup import attach
from rowmill.functions.ordering import global_rank
from rowmill.functions.storage import settle
from rowmill.operators.profile import distinct_counts, value_counts
from rowmill.operators.steps import Step, applies

# Indicator columns up to this many categories under ``auto``;
# the text a missing value becomes before codes are given.
ONE_HOT_LIMIT = 10
MISSING_TEXT = "nan"
# A table can only be so wide; more categories than this need another encoder.
ONE_HOT_WIDTH = 2000


def choose_encoder(method: str, n_distinct: int, target: str | None) -> str:
    if method != "auto":
        return method
    if n_distinct <= ONE_HOT_LIMIT:
        return "onehot"
    return "target" if target else "label"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, key, n, code)``: rank of each value among the sorted values
    of its column, ranked over range partitions for every column at once."""
    text = df.select(*[F.coalesce(present(df, c), F.lit(MISSING_TEXT)).alias(c) for c in columns])
    counts = value_counts(text, columns).withColumnRenamed("value", "key")
    ranked = global_rank(counts, [F.col("key")], "code", keys=["column"])
    return settle(ranked.withColumn("code", F.col("code") - 1))


def _target_means(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """``(column, key, n, mean)`` over all rows, pre-combined per task."""
    y = number(df, target)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(df, c).alias("key")) for c in columns])
    return settle(
        df.select(F.explode(pairs).alias("p"), y.alias("y"))
        .filter("p.key is not null")
        .groupBy("p.column", "p.key")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    )


def fit_encode(
    df: DataFrame,
    method: str = "auto",
    target: str | None = None,
    columns: list[str] | None = None,
) -> Step:
    """Fit the encoder of every string column except the target."""
    names = [c for c in (columns or categorical_columns(df)) if c != target]
    if not names:
        return Step("encode", {"plan": []})
    # A mean needs a numeric target; with a class target codes are used.
    mean_of = target if target and family(df.schema[target].dataType) != "categorical" else None
    sizes = {r["column"]: r["n_distinct"] for r in distinct_counts(df, names).collect()}
    plan = [
        {"column": c, "method": choose_encoder(method, sizes[c], mean_of), "n_distinct": sizes[c]} for c in names
    ]
    hot = [p["column"] for p in plan if p["method"] == "onehot"]
    if hot:
        wide = max(hot, key=lambda c: sizes[c])
        if sizes[wide] > ONE_HOT_WIDTH:
            raise ValueError(
                f"'{wide}' has {sizes[wide]} categories: too many for one column each; "
                "use label or target encoding"
            )
        found: dict[str, list[str]] = {c: [] for c in hot}
        for r in value_counts(df, hot).select("column", "value").collect():
            found[r["column"]].append(r["value"])
        for p in plan:
            if p["method"] == "onehot":
                p["categories"] = sorted(found[p["column"]])
    tables = {}
    labelled = [p["column"] for p in plan if p["method"] == "label"]
    if labelled:
        tables["codes"] = _label_codes(df, labelled)
    averaged = [p["column"] for p in plan if p["method"] == "target" and mean_of]
    if averaged:
        tables["means"] = _target_means(df, averaged, mean_of)
    return Step("encode", {"plan": plan, "target": mean_of}, tables)


@applies("encode")
def _encode(df: DataFrame, state: dict, tables: dict) -> DataFrame:
    for p in state["plan"]:
        c = p["column"]
        if p["method"] == "onehot":
            flags = [
                F.coalesce(col(c) == v, F.lit(False)).alias(f"{c}_{v}") for v in p["categories"][1:]
            ]
            df = df.select(*[col(k) for k in df.columns if k != c], *flags)
        elif p["method"] == "label":
            text = df.withColumn(c, F.coalesce(present(df, c), F.lit(MISSING_TEXT)))
            codes = tables["codes"].filter(F.col("column") == c).select("key", "n", F.col("code").alias(f"{c}_encoded"))
            df = attach(text, codes, c, [f"{c}_encoded"]).drop(c)
        elif p["method"] == "target" and state["target"]:
            means = tables["means"].filter(F.col("column") == c).select(
                "key", "n", F.col("mean").alias(f"{c}_target_encoded")
            )
            df = attach(df, means, c, [f"{c}_target_encoded"]).drop(c)
    return df
