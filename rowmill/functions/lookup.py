"""Lookup joins whose strategy follows the measured size of the lookup side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col

BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def attach(
    df: DataFrame,
    table: DataFrame,
    key: str,
    values: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Left-join ``table`` (columns ``key``, ``n`` and ``values``) onto ``df``.

    ``n`` is how many rows held the key when the table was fitted.  A table
    measured below ``broadcast_bytes`` is broadcast.  Beyond that it is
    shuffled, and each key hot enough to fill a task alone, and the missing
    one, is spread over ``salts`` tasks, its single lookup row being repeated once per salt.
    """
    size = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0))).alias("bytes"),
        F.sum("n").alias("total"),
    ).first()
    measured = (size["bytes"] or 0) + 16 * (len(values) + 1) * size["rows"]
    right = table.select(F.col("key").alias("_key"), "n", *values)
    if measured <= broadcast_bytes:
        return df.join(F.broadcast(right.drop("n")), col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows = max(1, (size["total"] or 0) // (4 * width))
    # Fewer than 4 * width keys can pass, since each holds more than that share.
    hot = [r["_key"] for r in right.filter(F.col("n") > hot_rows).select("_key").collect()]
    # A missing key may be as frequent as any and unknown to the fitted table, so it is always spread.
    is_hot = col(key).isNull() | (F.coalesce(col(key).isin(hot), F.lit(False)) if hot else F.lit(False))
    # Salting by map task is repeatable when a lost task is run again.
    left = df.withColumn(
        "_salt", F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    )
    spread = F.when((F.col("n") > hot_rows) | F.col("_key").isNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = right.withColumn("_salt2", F.explode(spread)).drop("n")
    on = col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt2"))
    return left.join(right, on, "left").drop("_key", "_salt", "_salt2")
