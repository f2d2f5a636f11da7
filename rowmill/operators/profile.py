"""The profiler: shape, missing cells, statistics, quality and advice.

Each function returns a tidy DataFrame.  Whole-table statistics share one wide
aggregate; everything that depends on distinct values of a column comes from
one ``(column, value, n)`` table whose shuffle is pre-combined per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.columns import (
    categorical_columns,
    col,
    digest,
    families,
    family,
    is_missing,
    long_rows,
    number,
    numeric_columns,
    present,
)
from rowmill.functions.quantiles import quantiles
from rowmill.functions.stats import ratio, skew_g1
from rowmill.operators.shards import summed

# Thresholds of the quality score and of the advice rules.
MISSING_HIGH, MISSING_HIGH_COST = 50.0, 30.0
MISSING_SOME, MISSING_SOME_COST = 20.0, 15.0
DUPLICATE_COST_LIMIT = 20.0
CONSTANT_COST = 5.0
CARDINALITY_SHARE, CARDINALITY_COST = 0.5, 10.0
IQR_FACTOR = 1.5
ADVISE_MISSING = 5.0
ADVISE_TARGET_ENCODING = 20
ADVISE_SELECTION_COLUMNS = 100


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and cells of the table, with the width of each family."""
    groups = families(df)
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        (F.col("n_rows") * width).alias("n_cells"),
        *[F.lit(len(v)).cast("bigint").alias(f"n_{k}") for k, v in groups.items() if k != "other"],
    )


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, family and type."""
    rows = [
        (i, f.name, family(f.dataType), f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, family string, type string")


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, from one scan."""
    columns = columns or df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(is_missing(df, c)).alias(f"m_{c}") for c in columns],
    )
    return long_rows(
        wide,
        columns,
        {
            "missing": lambda c: col(f"m_{c}"),
            "missing_pct": lambda c: ratio(col(f"m_{c}") * 100.0, F.col("_n"), 0.0),
        },
    )


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows strictly outside ``(low, high)`` per column."""
    wide = df.agg(
        *[
            F.count_if((number(df, c) < lo) | (number(df, c) > hi)).alias(f"o_{c}")
            for c, (lo, hi) in bounds.items()
        ]
    )
    return long_rows(wide, list(bounds), {"outliers": lambda c: col(f"o_{c}")})


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = IQR_FACTOR) -> dict[str, tuple]:
    found = quantiles(df, {c: [0.25, 0.75] for c in columns})
    out = {}
    for c, q in found.items():
        if q[0.25] is not None:
            reach = factor * (q[0.75] - q[0.25])
            out[c] = (q[0.25] - reach, q[0.75] + reach)
    return out


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Describe + missing + skewness + outlier count per numeric column."""
    columns = columns or numeric_columns(df)
    quarts = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        x, q = number(df, c), quarts[c]
        # Plain sums of powers keep the aggregate small enough for generated
        # code; measured from the median they do not cancel.
        d = x - F.lit(q[0.5] or 0.0)
        if q[0.25] is None:
            outside = F.lit(False)
        else:
            reach = IQR_FACTOR * (q[0.75] - q[0.25])
            outside = (x < q[0.25] - reach) | (x > q[0.75] + reach)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.sum(d).alias(f"a{i}"),
            F.sum(d * d).alias(f"b{i}"),
            F.sum(d * d * d).alias(f"c{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
            F.count_if(outside).alias(f"o{i}"),
        ]
    at = {c: i for i, c in enumerate(columns)}

    def of(prefix: str, c: str) -> Column:
        return F.col(f"{prefix}{at[c]}")

    def n(c: str) -> Column:
        return F.nullif(of("n", c), F.lit(0)).cast("double")

    def shift(c: str) -> Column:
        return of("a", c) / n(c)

    def square(c: str) -> Column:
        return F.when(of("hi", c) > of("lo", c), of("b", c) - n(c) * shift(c) * shift(c)).otherwise(F.lit(0.0))

    def skew(c: str) -> Column:
        k, m, s2 = n(c), shift(c), square(c)
        cube = of("c", c) - 3 * m * of("b", c) + 2 * k * m * m * m
        g1 = F.when(s2 > 0, F.sqrt(k) * cube / F.pow(s2, F.lit(1.5))).otherwise(F.lit(0.0))
        return F.when(k > 2, g1 * F.sqrt(k * (k - 1)) / (k - 2))

    def quart(p: float):
        return lambda c: F.lit(quarts[c][p]).cast("double")

    return long_rows(
        df.agg(*aggs),
        columns,
        {
            "count": lambda c: of("n", c),
            "mean": lambda c: shift(c) + F.lit(quarts[c][0.5] or 0.0),
            "std": lambda c: F.when(n(c) > 1, F.sqrt(square(c) / (n(c) - 1))),
            "min": lambda c: of("lo", c),
            "max": lambda c: of("hi", c),
            "skewness": skew,
            "outliers": lambda c: of("o", c),
            "q25": quart(0.25),
            "median": quart(0.5),
            "q75": quart(0.75),
            "missing": lambda c: F.col("_n") - of("n", c),
        },
    )


#: Columns of a block: a task holds the sums of one pair of blocks (3 MB).
BLOCK = 256
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _gram(left: list[float], right: list[float]):
    """Per task: sums over rows where both columns are present, for each column
    of a left block (means ``left``) with each of a right one.  One row per
    left column, its sums for all right columns after each other."""
    cut = len(left)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, cut, len(right)))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64)
            seen = ~np.isnan(x)
            x = np.where(seen, x - [*left, *right], 0.0)
            m, sq = seen.astype(np.float64), x * x
            ma, mb, xa, xb = m[:, :cut], m[:, cut:], x[:, :cut], x[:, cut:]
            total += np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, sq[:, :cut].T @ mb, ma.T @ sq[:, cut:], xa.T @ xb])
        yield pd.DataFrame({"i": range(cut), "sums": [total[:, i].ravel() for i in range(cut)]})

    return gram


def _means(df: DataFrame, columns: list[str]) -> list[float]:
    """The mean of each column, 0 where all is missing."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(columns)), np.zeros(len(columns))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64)
            n += (~np.isnan(x)).sum(0)
            total += np.nansum(x, 0)
        yield pd.DataFrame({"sums": [np.concatenate([total, n])]})

    sums = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(add, "sums array<double>")
    total, n = np.split(summed(sums, "sums", 2 * len(columns)), 2)
    return (total / np.maximum(n, 1)).tolist()


def _block_pair(df: DataFrame, left: list[str], right: list[str], means: dict[str, float]) -> DataFrame:
    """a, b and the sums of each column of ``left`` with each of ``right``."""
    width = len(right)
    asked = [number(df, c).alias(f"c{i}") for i, c in enumerate([*left, *right])]
    sums = (
        df.select(*asked)
        .mapInPandas(_gram([means[c] for c in left], [means[c] for c in right]), "i int, sums array<double>")
        .groupBy("i")
        .agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
        .withColumn("s", vector_to_array("s"))
    )
    at = lambda p: F.col("s")[F.col("j") + p * width].alias(_SUMS[p])
    return sums.select("i", "s", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j")).select(
        F.array(*[F.lit(c) for c in left])[F.col("i")].alias("a"),
        F.array(*[F.lit(c) for c in right])[F.col("j")].alias("b"),
        "i",
        "j",
        *[at(p) for p in range(6)],
    )


def correlation(df: DataFrame, columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pearson correlation of every column pair (a <= b in table order).

    Pairwise complete: a row counts for a pair when both values are present.
    Tables up to ``block`` columns take one scan.  Wider ones take one for each
    pair of column blocks, which reads those two blocks alone; no task, row or
    driver object holds the sums of more than one pair of blocks.  A column
    without two different values has no correlation (NULL), and no columns give
    no rows.
    """
    columns = columns or numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    means = dict(zip(columns, _means(df, columns)))
    blocks = [columns[i : i + block] for i in range(0, len(columns), block)]
    pairs = [
        _block_pair(df, one, two, means).filter(F.col("i") <= F.col("j")) if one is two else _block_pair(df, one, two, means)
        for x, one in enumerate(blocks)
        for two in blocks[x:]
    ]
    n = F.nullif(F.col("n"), F.lit(0.0))
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    return reduce(DataFrame.unionByName, pairs).select("a", "b", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("corr"))


def skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or numeric_columns(df)
    wide = df.agg(*[skew_g1(number(df, c)).alias(f"g_{c}") for c in columns])
    return long_rows(wide, columns, {"skewness": lambda c: col(f"g_{c}")})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` for the non-missing values of string columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.value")
        .filter("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column.

    Exact by default, on digests of long strings; ``approximate`` trades it for
    a HyperLogLog sketch with no shuffle of values.
    """
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"d_{c}") for c in columns])
        return long_rows(wide, columns, {"n_distinct": lambda c: col(f"d_{c}")})
    short = df.select(
        *[digest(present(df, c).cast("string")).alias(c) for c in columns]
    )
    counted = value_counts(short, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")
    )


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column; ties give the smallest value."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode"),
        F.max("n").alias("mode_count"),
    )


def _first_per_column(counts: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Top rows per column.  Spark limits each task's rows per column before
    the shuffle (WindowGroupLimit), so no task sees a whole column."""
    w = Window.partitionBy("column").orderBy(*order)
    return counts.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def top_values(counts: DataFrame, limit: int = 10) -> DataFrame:
    return _first_per_column(counts, [F.desc("n"), F.asc("value")], limit)


def first_values(counts: DataFrame, limit: int = 20) -> DataFrame:
    """The first distinct values, in value order so the list is repeatable."""
    return _first_per_column(counts, [F.asc("value")], limit).select("column", "position", "value")


def categorical_profile(counts: DataFrame) -> DataFrame:
    """Distinct count, mode, and the first 20 distinct values per column."""
    base = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_values"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("mode"),
        F.max("n").alias("mode_count"),
    )
    firsts = (
        first_values(counts)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("v"))
        .select("column", F.array_join(F.transform("v", lambda s: s["value"]), "|").alias("first_values"))
    )
    return base.join(firsts, "column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows; missing equals missing.

    Long strings are compared by digest, so documents are not shuffled.
    """
    keys = [
        (digest(col(f.name)) if family(f.dataType) == "categorical" else col(f.name)).alias(f"k{i}")
        for i, f in enumerate(df.schema.fields)
    ]
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _list_names(flags: list[tuple[str, Column]]) -> Column:
    """Comma-joined names of the columns whose flag holds."""
    return F.array_join(F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags])), ",")


def quality(df: DataFrame) -> DataFrame:
    """One row: score, duplicate rows, constant and high-cardinality columns.

    A column is constant when its least and greatest values agree, so only the
    string columns need a distinct count.
    """
    strings = categorical_columns(df)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(df.columns):
        x = present(df, c)
        aggs += [
            F.count_if(is_missing(df, c)).alias(f"m{i}"),
            F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"k{i}"),
        ]
    facts = df.agg(*aggs).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    if strings:
        by_column = distinct_counts(df, strings).agg(
            F.map_from_entries(F.collect_list(F.struct("column", "n_distinct"))).alias("d")
        )
        facts = facts.withColumn("_d", by_column.scalar())
    rows = F.col("n_rows")
    constant = [(c, F.col(f"k{i}")) for i, c in enumerate(df.columns)]
    crowded = [(c, F.col("_d")[c] > rows * CARDINALITY_SHARE) for c in strings]

    def hits(flags: list[tuple[str, Column]]) -> Column:
        return reduce(lambda a, b: a + b, [f.cast("int") for _, f in flags], F.lit(0))

    missing = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(len(df.columns))])
    missing_pct = ratio(missing * 100.0, rows * len(df.columns), 0.0)
    dup_pct = ratio(F.col("duplicate_rows") * 100.0, rows, 0.0)
    score = (
        F.lit(100.0)
        - F.when(missing_pct > MISSING_HIGH, F.lit(MISSING_HIGH_COST))
        .when(missing_pct > MISSING_SOME, F.lit(MISSING_SOME_COST))
        .otherwise(F.lit(0.0))
        - F.least(F.lit(DUPLICATE_COST_LIMIT), dup_pct)
        - hits(constant) * CONSTANT_COST
        - hits(crowded) * CARDINALITY_COST
    )
    level = F.when(missing_pct > MISSING_HIGH, F.lit("High percentage of missing values (>50%)")).when(
        missing_pct > MISSING_SOME, F.lit("Moderate missing values (>20%)")
    )
    issues = F.array_compact(
        F.array(
            level,
            F.when(F.col("duplicate_rows") > 0, F.format_string("%d duplicate rows found", "duplicate_rows")),
            F.when(hits(constant) > 0, F.concat(F.lit("Constant columns found: "), _list_names(constant))),
            F.when(
                hits(crowded) > 0,
                F.concat(F.lit("High cardinality categorical columns: "), _list_names(crowded)),
            ),
        )
    )
    return facts.select(
        "n_rows",
        missing.alias("missing_cells"),
        missing_pct.alias("missing_pct"),
        "duplicate_rows",
        _list_names(constant).alias("constant_columns"),
        _list_names(crowded).alias("high_cardinality_columns"),
        F.array_join(issues, "; ").alias("issues"),
        F.greatest(F.lit(0.0), score).alias("quality_score"),
    )


def recommendations(df: DataFrame) -> DataFrame:
    """``(rule, column)`` rows; table-wide rules leave ``column`` empty."""
    spark = df.sparkSession
    groups = families(df)
    numeric, strings = groups["numeric"], groups["categorical"]
    parts = []

    def fixed(rule: str) -> DataFrame:
        return spark.createDataFrame([(rule, "")], "rule string, column string")

    cells = missing_report(df).agg(F.avg("missing_pct").alias("pct"))
    parts.append(
        cells.filter(F.col("pct") > ADVISE_MISSING).select(F.lit("impute").alias("rule"), F.lit("").alias("column"))
    )
    if numeric:
        parts.append(fixed("scale"))
        bounds = iqr_bounds(df, numeric)
        if bounds:
            parts.append(
                outlier_counts(df, bounds).filter("outliers > 0").select(F.lit("treat_outliers").alias("rule"), "column")
            )
    if strings:
        crowded = distinct_counts(df, strings).filter(F.col("n_distinct") > ADVISE_TARGET_ENCODING)
        parts.append(crowded.select(F.lit("target_encode").alias("rule"), "column"))
        parts.append(
            crowded.agg(F.count(F.lit(1)).alias("k"))
            .filter("k = 0")
            .select(F.lit("one_hot").alias("rule"), F.lit("").alias("column"))
        )
    if len(df.columns) > ADVISE_SELECTION_COLUMNS:
        parts.append(fixed("select_features"))
    return reduce(DataFrame.unionByName, parts)


def summary_text(df: DataFrame) -> DataFrame:
    """The table in four lines of text."""
    groups = families(df)
    width = len(df.columns)
    cells = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    missing = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(width)])
    return cells.select(
        F.concat_ws(
            "\n",
            F.format_string(f"Dataset Shape: %d rows, {width} columns", "n"),
            F.lit(f"Column Types: {len(groups['numeric'])} numeric, {len(groups['categorical'])} categorical"),
            F.format_string(
                "Missing Values: %d (%.1f%%)", missing, ratio(missing * 100.0, F.col("n") * width, 0.0)
            ),
            F.format_string("Duplicate Rows: %d", "duplicate_rows"),
        ).alias("summary")
    )
