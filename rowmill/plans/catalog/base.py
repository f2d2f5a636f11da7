"""Registration of queries and the inputs they share.

Views that give missing values, predictions or job histories to the read-only
tables are written twice, as a DataFrame and as SQL, with the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 4


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; without ``sql`` only its rows can be checked."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and turn flags into 0/1, as the SQL side does."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "boolean":
            c = c.cast("int")
        out.append(c.alias(name))
    return df.select(*out)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL rounding without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


# Numeric columns of lineitem, and the four that are measures.
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """orders with missing values at several rates."""
    k, total = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.when(k % 13 != 0, total).alias("g_mean"),
        F.when(k % 5 != 0, total).alias("g_median"),
        # NaN instead of NULL: both count as missing.
        F.when(k % 5 >= 2, total).otherwise(F.lit(float("nan"))).alias("g_knn"),
        F.when(k % 5 >= 3, total).alias("g_drop"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("g_cat"),
    )


GAPS = """gaps as (
  select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
    case when o_orderkey % 13 <> 0 then o_totalprice end as g_mean,
    case when o_orderkey % 5 <> 0 then o_totalprice end as g_median,
    case when o_orderkey % 5 >= 2 then o_totalprice end as g_knn,
    case when o_orderkey % 5 >= 3 then o_totalprice end as g_drop,
    case when o_orderkey % 7 <> 0 then o_orderpriority end as g_cat
  from orders)"""
GAP_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "g_mean", "g_median", "g_knn", "g_drop", "g_cat"]


def class_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Return flag with a rule-made prediction and rule-made scores."""
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("actual"),
        F.when(d > 0.07, "R").when(t > 0.05, "A").otherwise("N").alias("predicted"),
        (F.col("l_returnflag") == "R").alias("positive"),
        F.round(d * 7 + t * 3, 4).alias("score"),
        F.round(d * 5, 4).alias("score_a"),
        F.round(t * 6, 4).alias("score_n"),
        F.round(F.lit(0.9) - d * 3, 4).alias("score_r"),
    )


CLASS_PRED = """class_pred as (
  select l_returnflag as actual,
    case when l_discount > 0.07 then 'R' when l_tax > 0.05 then 'A' else 'N' end as predicted,
    l_returnflag = 'R' as positive,
    round(l_discount * 7 + l_tax * 3, 4) as score,
    round(l_discount * 5, 4) as score_a,
    round(l_tax * 6, 4) as score_n,
    round(0.9::double - l_discount * 3, 4) as score_r
  from lineitem)"""


def reg_pred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * 1500.0 + 200.0).alias("predicted"),
        F.col("l_tax").alias("actual_zero"),
    )


REG_PRED = """reg_pred as (
  select l_extendedprice as actual, l_quantity * 1500.0::double + 200.0::double as predicted,
    l_tax as actual_zero
  from lineitem)"""


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """events read as training history."""
    e, v = F.col("event_id"), F.col("value")
    metrics = F.create_map(
        F.lit("f1_score"), F.when(e % 2 == 0, F.round(v / 500, 4)),
        F.lit("r2_score"), F.when(e % 3 == 0, F.round(1 - v / 500, 4)),
        F.lit("mse"), F.when(e % 5 == 0, v),
    )
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed").when(kind.isin("purchase", "signup"), "completed").otherwise("running")
    )
    return table(spark, sf, "events").select(
        e.alias("job_id"),
        F.concat(F.lit("algorithm_"), F.col("user_id") % 7).alias("algorithm"),
        status.alias("status"),
        F.map_filter(metrics, lambda _, x: x.isNotNull()).alias("metrics"),
        F.col("ts").alias("end_time"),
    )


JOB_LOG = """job_log as (
  select event_id as job_id, 'algorithm_' || (user_id % 7) as algorithm,
    case when event_type = 'error' then 'failed'
         when event_type in ('purchase', 'signup') then 'completed' else 'running' end as status,
    case when event_id % 2 = 0 then round(value / 500, 4) end as f1_score,
    case when event_id % 3 = 0 then round(1 - value / 500, 4) end as r2_score,
    case when event_id % 5 = 0 then value end as mse,
    ts as end_time
  from events)"""
