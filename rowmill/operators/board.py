"""Rankings and statistics over models and training history.

A history table has ``job_id, algorithm, status, metrics map<string,double>,
end_time`` and any further columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.columns import col
from rowmill.functions.ordering import global_rank
from rowmill.functions.stats import ratio

# Metric choice per problem, priorities, tiers, directions.
DEFAULT_METRIC = {
    "classification": "f1_score",
    "regression": "r2_score",
    "clustering": "silhouette_score",
}
OTHER_METRIC = "accuracy"
BEST_PRIORITY = ["accuracy", "f1_score", "r2_score", "silhouette_score"]
SUMMARY_PRIORITY = ["accuracy", "f1_score", "r2_score", "mse", "silhouette_score"]
TIERS = [(0.9, "excellent"), (0.8, "good"), (0.7, "fair")]
LOWEST_TIER, NO_TIER = "poor", "unknown"
LOWER_IS_BETTER = ["mse", "rmse", "mae", "median_ae", "max_error", "mape", "davies_bouldin_score"]
HISTORY_LIMIT, BEST_LIMIT, REPORT_BEST, MAX_TRIALS = 50, 10, 20, 10


def comparison_metric(problem: str, metric: str = "auto") -> str:
    return DEFAULT_METRIC.get(problem, OTHER_METRIC) if metric == "auto" else metric


def _cost(metric: Column, value: Column) -> Column:
    """The value with its sign set so that smaller is better."""
    return F.when(metric.isin(LOWER_IS_BETTER), value).otherwise(-value)


def rank_models(scores: DataFrame, metric: str) -> DataFrame:
    """Rank ``(model, metric, value)`` rows by one metric, best first."""
    rows = scores.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    cost = _cost(F.lit(metric), F.col("value"))
    return global_rank(rows, [cost, F.col("model")], "rank")


def ranking_summary(scores: DataFrame, metric: str) -> DataFrame:
    """Models compared, best, worst, mean and population deviation."""
    value = F.col("value")
    cost = _cost(F.lit(metric), value)
    return scores.filter((F.col("metric") == metric) & value.isNotNull()).agg(
        F.count(F.lit(1)).alias("total_models"),
        F.lit(metric).alias("metric_used"),
        F.min_by(value, cost).alias("best_score"),
        F.max_by(value, cost).alias("worst_score"),
        F.avg(value).alias("mean_score"),
        F.stddev_pop(value).alias("std_score"),
    )


def _first_present(metrics: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.when(metrics[n].isNotNull(), F.lit(n)) for n in names])


def best_models(
    history: DataFrame, metric: str | None = None, algorithm: str | None = None, limit: int = BEST_LIMIT
) -> DataFrame:
    """Top completed jobs.  Without ``metric`` the first eligible job decides
    it for all: the first of accuracy, F1, R2, silhouette that it carries."""
    jobs = history.filter((F.col("status") == "completed") & (F.size("metrics") > 0))
    if algorithm:
        jobs = jobs.filter(F.col("algorithm") == algorithm)
    if metric:
        name = F.lit(metric)
    else:
        carried = _first_present(F.col("metrics"), BEST_PRIORITY)
        name = jobs.agg(
            F.min_by(carried, F.when(carried.isNotNull(), F.struct("end_time", "job_id")))
        ).scalar()
    named = jobs.withColumn("metric_name", name).withColumn("metric_value", F.col("metrics")[F.col("metric_name")])
    return (
        named.filter("metric_value is not null")
        .orderBy(_cost(F.col("metric_name"), F.col("metric_value")), "end_time", "job_id")
        .limit(limit)
    )


def job_totals(history: DataFrame) -> DataFrame:
    """Jobs by outcome and the share completed."""
    done = F.count_if(F.col("status") == "completed")
    failed = F.count_if(F.col("status") == "failed")
    total = F.count(F.lit(1))
    return history.agg(
        total.alias("total_jobs"),
        done.alias("completed_jobs"),
        failed.alias("failed_jobs"),
        (total - done - failed).alias("active_jobs"),
        ratio(done, total, 0.0).alias("success_rate"),
    )


def algorithm_usage(history: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Trainings, successes and success rate per algorithm."""
    rows = history.filter(F.col("algorithm") == algorithm) if algorithm else history
    done = F.count_if(F.col("status") == "completed")
    return rows.groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("total_trainings"),
        done.alias("successful_trainings"),
        ratio(done, F.count(F.lit(1)), 0.0).alias("success_rate"),
    )


def performance_summary(history: DataFrame) -> DataFrame:
    """Primary metric and tier per job; jobs without any metric are left out."""
    name = _first_present(F.col("metrics"), SUMMARY_PRIORITY)
    score = F.col("primary_score")
    tier = reduce(lambda acc, t: F.when(score >= t[0], t[1]).otherwise(acc), TIERS[::-1], F.lit(LOWEST_TIER))
    return (
        history.withColumn("primary_metric", name)
        .filter("primary_metric is not null")
        .withColumn("primary_score", F.col("metrics")[F.col("primary_metric")])
        .withColumn(
            "performance_tier", F.when(F.col("primary_metric").isin(LOWER_IS_BETTER), NO_TIER).otherwise(tier)
        )
    )


def newest(rows: DataFrame, time: str, key: str, limit: int = HISTORY_LIMIT, **where: str) -> DataFrame:
    """Newest first, optionally filtered by equality, cut to ``limit``.

    Planned as a top-k: each task keeps only its own ``limit`` rows.
    """
    for name, value in where.items():
        rows = rows.filter(col(name) == value)
    return rows.orderBy(col(time).desc(), col(key).asc()).limit(limit)


def all_deployments(active: DataFrame, past: DataFrame, status: str | None = None) -> DataFrame:
    """Active and past deployments in one list (a bag union)."""
    rows = active.unionByName(past, allowMissingColumns=True)
    return rows.filter(F.col("status") == status) if status else rows


def parameter_grid(lists: DataFrame, names: list[str], max_trials: int = MAX_TRIALS, seed: int = 42) -> DataFrame:
    """Trials from one row of value arrays: every combination, or
    ``max_trials`` of them chosen by hash order when there are more.

    The product is unfolded array by array; no join is involved.
    """
    grid = lists
    for n in names:
        grid = grid.withColumn(n, F.explode(col(n)))
    tag = F.md5(F.concat_ws("|", *[col(n).cast("string") for n in names], F.lit(str(seed))))
    # limit() keeps max_trials rows, few enough to number in one task.
    kept = grid.withColumn("trial_key", tag).orderBy("trial_key").limit(max_trials)
    numbered = kept.groupBy().agg(F.array_sort(F.collect_list(F.struct("trial_key", *names))).alias("t"))
    return numbered.select(F.posexplode("t").alias("i", "c")).select(
        (F.col("i") + 1).alias("trial_number"), *[F.col("c")[n].alias(n) for n in names]
    )


def training_report(spark: SparkSession, history: DataFrame) -> dict[str, DataFrame]:
    """The parts of the training report, ready to be written."""
    return {
        "statistics": job_totals(history),
        "algorithms": algorithm_usage(history),
        "history": newest(history, "end_time", "job_id"),
        "best_models": best_models(history, limit=REPORT_BEST),
        "active_jobs": history.filter(~F.col("status").isin("completed", "failed")),
    }
