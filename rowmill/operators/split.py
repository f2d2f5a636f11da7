"""Deterministic train/test split that moves no rows.

Rows are ordered by the MD5 of key and seed; the first ``quota`` of each class
are the test rows.  Sorting a whole class into place would shuffle the table
and pile a large class onto one task.  Since MD5 is uniform, the quota-th digest
is found by counting instead: digests are counted by their leading hex digits,
the prefix that holds the quota is located, and only that prefix is ordered.
The table itself is then read once more with a comparison per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.columns import col, is_missing, present
from rowmill.functions.lookup import attach
from rowmill.functions.ordering import global_rank
from rowmill.functions.storage import settle

STRATIFY_SHARE = 0.5


def split_digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(col(key).cast("string"), F.lit(f":{seed}")))


def _quotas(classes: DataFrame, test_rows: int, total: int) -> DataFrame:
    """Share ``test_rows`` over the classes by largest remainder.

    Equal remainders go to the smaller class value first.
    """
    exact = F.col("n") * F.lit(test_rows)
    shares = classes.withColumns(
        {"whole": F.floor(exact / F.lit(total)), "rest": exact % F.lit(total)}
    )
    spare = test_rows - (shares.agg(F.sum("whole")).first()[0] or 0)
    ranked = global_rank(shares, [F.desc("rest"), F.asc_nulls_first("key")], "at")
    return ranked.select(
        "key", "n", (F.col("whole") + (F.col("at") <= spare).cast("bigint")).alias("quota")
    )


def _thresholds(rows: DataFrame, quotas: DataFrame, total: int) -> DataFrame:
    """``(key, n, threshold)``: the quota-th smallest digest of each class.

    The leading digits are chosen so that both the prefix table and the rows
    within one prefix stay near the square root of the class size.
    """
    digits = min(32, max(1, math.ceil(math.log(max(2, total), 16) / 2)))
    counts = rows.groupBy("y", F.substring("h", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("y").orderBy("p")))
    found = (
        attach(run, quotas.withColumn("size", F.col("n")), "y", ["quota", "size"])
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
        .select(
            F.col("y").alias("key"),
            F.col("size").alias("n"),
            F.col("p").alias("edge"),
            (F.col("quota") - (F.col("upto") - F.col("c"))).alias("left"),
        )
    )
    found = settle(found)
    near = attach(rows, found.withColumn("size", F.col("n")), "y", ["edge", "left", "size"]).filter(F.substring("h", 1, digits) == F.col("edge"))
    at = Window.partitionBy("y").orderBy("h")
    return settle(
        near.withColumn("at", F.row_number().over(at))
        .filter(F.col("at") == F.col("left"))
        .select(F.col("y").alias("key"), F.col("size").alias("n"), F.col("h").alias("threshold"))
    )


def with_split(
    df: DataFrame,
    key: str,
    target: str | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Add ``train`` / ``test`` per row; ``key`` must identify rows.

    A NULL key cannot be ordered and is refused; rows that share a key stay on
    one side, so repeated keys may move the sides' sizes a little.

    Stratified over ``target`` when it has more than one class and fewer
    classes than half the rows; otherwise one quota for the whole table.
    """
    if target:
        df = df.filter(~is_missing(df, target))
    y = present(df, target) if target else F.lit(0)
    facts = df.select(y.alias("key"), col(key).isNull().cast("bigint").alias("_no_key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_no_key").alias("no_key")
    )
    facts = settle(facts)
    k, total, no_key = facts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("no_key")).first()
    if no_key:
        raise ValueError(f"{no_key} rows have no value in the split key {key!r}")
    facts = facts.drop("no_key")
    if not total:
        raise ValueError("Features or target data is empty")
    test_rows = math.ceil(total * test_size - 1e-9)
    if test_rows >= total:
        raise ValueError("no rows would be left for training")
    stratify = bool(target) and 1 < k < STRATIFY_SHARE * total
    if not stratify:
        y = F.lit(0)
        facts = df.sparkSession.createDataFrame([(0, total)], "key int, n bigint")
    quotas = settle(_quotas(facts, test_rows, total))
    rows = df.select(y.alias("y"), split_digest(key, seed).alias("h"))
    limits = _thresholds(rows, quotas, total)
    marked = df.withColumns({"_y": y, "_h": split_digest(key, seed)})
    joined = attach(marked, limits, "_y", ["threshold"])
    return joined.withColumn(
        name, F.when(F.col("_h") <= F.col("threshold"), "test").otherwise("train")
    ).drop("_y", "_h", "threshold")


def split_summary(df: DataFrame, target: str, name: str = "split") -> DataFrame:
    """Rows and feature count per side of the split."""
    features = len([c for c in df.columns if c not in (target, name)])
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(features).cast("bigint").alias("n_features")
    )
