"""Running totals over a total order without a one-task window.

``sum() over (order by x)`` with no partition key sends every row to one task.
Here rows are range-partitioned by the order, each range keeps its own running
sums, and the totals of the earlier ranges are added as an offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.storage import settle


def running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str] | None = None
) -> DataFrame:
    """Add running sums (current row included) per ``keys`` along ``order``.

    Rows must be unique in (keys, order) for the result to be well defined.
    One hot key is no problem: it simply spans several ranges.
    """
    keys = keys or []
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    ranged = settle(
        ranged.repartitionByRange(width, *[F.col(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    totals = ranged.groupBy("_range", *keys).agg(
        *[F.sum(f"_v_{k}").alias(f"_o_{k}") for k in sums]
    )
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # Rows come ordered by key, so in each range only its first key can have
    # started earlier: this side never has more rows than there are ranges.
    offsets = totals.withColumns({f"_o_{k}": F.sum(f"_o_{k}").over(earlier) for k in sums}).filter(
        " or ".join(f"_o_{k} is not null" for k in sums)
    )
    here = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = ranged.withColumns({k: F.sum(f"_v_{k}").over(here) for k in sums}).join(
        F.broadcast(offsets), ["_range", *keys], "left"
    )
    return joined.withColumns(
        {k: F.col(k) + F.coalesce(F.col(f"_o_{k}"), F.lit(0)) for k in sums}
    ).drop("_range", *[f"_v_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def global_rank(df: DataFrame, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """1-based position of each row along ``order`` (per ``keys``)."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, keys)
