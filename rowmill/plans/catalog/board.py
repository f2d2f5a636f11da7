"""Leaderboard, job-history and registry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import checkpoint_folder
from rowmill.operators import board as B
from rowmill.plans.catalog.base import JOB_LOG, job_log, query, r, table, tidy
from rowmill.sources import registry
from rowmill.sources.writers import append_results, metric_rows, write_report

_SCORES = """scores as (select 'user_' || user_id as model, 'mse' as metric, avg(value) as value from events group by user_id)"""


def _user_scores(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.avg("value").alias("value"))
        .select(F.concat(F.lit("user_"), "user_id").alias("model"), F.lit("mse").alias("metric"), "value")
    )


@query(
    "leaderboard",
    f"""with {_SCORES} select model, metric, {r("value")} as value,
      row_number() over (order by value, model) as rank from scores""",
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.rank_models(_user_scores(spark, sf), "mse"))


@query(
    "leaderboard_summary",
    f"""with {_SCORES} select count(*) as total_models, 'mse' as metric_used, {r("min(value)")} as best_score,
      {r("max(value)")} as worst_score, {r("avg(value)")} as mean_score, {r("stddev_pop(value)")} as std_score from scores""",
)
def leaderboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.ranking_summary(_user_scores(spark, sf), "mse"))


_BEST = """c as (select * from job_log where status = 'completed' and (f1_score is not null or r2_score is not null or mse is not null)),
m as (select case when f1_score is not null then 'f1_score' else 'r2_score' end as name from c
  where f1_score is not null or r2_score is not null order by end_time, job_id limit 1),
v as (select job_id, algorithm, name as metric_name, case name when 'f1_score' then f1_score else r2_score end as metric_value,
  end_time from c, m)"""


def _best_rows(df: DataFrame) -> DataFrame:
    return tidy(df.select("job_id", "algorithm", "metric_name", "metric_value"))


@query(
    "best_models",
    f"""with {JOB_LOG}, {_BEST} select job_id, algorithm, metric_name, {r("metric_value")} as metric_value from v
    where metric_value is not null order by metric_value desc, end_time, job_id limit 10""",
)
def best_models(spark: SparkSession, sf: str) -> DataFrame:
    return _best_rows(B.best_models(job_log(spark, sf)))


@query(
    "best_models_lowest",
    f"""with {JOB_LOG} select job_id, algorithm, 'mse' as metric_name, {r("mse")} as metric_value from job_log
    where status = 'completed' and mse is not null and algorithm = 'algorithm_3' order by mse, end_time, job_id limit 10""",
)
def best_models_lowest(spark: SparkSession, sf: str) -> DataFrame:
    return _best_rows(B.best_models(job_log(spark, sf), "mse", "algorithm_3"))


@query(
    "job_stats",
    f"""with {JOB_LOG} select count(*) as total_jobs, count(*) filter (status = 'completed') as completed_jobs,
      count(*) filter (status = 'failed') as failed_jobs, count(*) filter (status = 'running') as active_jobs,
      {r("count(*) filter (status = 'completed') / count(*)")} as success_rate from job_log""",
)
def job_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.job_totals(job_log(spark, sf)))


@query(
    "algorithm_usage",
    f"""with {JOB_LOG} select algorithm, count(*) as total_trainings, count(*) filter (status = 'completed') as successful_trainings,
      {r("count(*) filter (status = 'completed') / count(*)")} as success_rate from job_log group by algorithm""",
)
def algorithm_usage(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(B.algorithm_usage(job_log(spark, sf)))


@query(
    "perf_tier",
    f"""with {JOB_LOG}, p as (select job_id, case when f1_score is not null then 'f1_score' when r2_score is not null then 'r2_score'
      when mse is not null then 'mse' end as primary_metric, coalesce(f1_score, r2_score, mse) as s from job_log)
    select job_id, primary_metric, {r("s")} as primary_score, case when primary_metric = 'mse' then 'unknown' when s >= 0.9 then 'excellent'
      when s >= 0.8 then 'good' when s >= 0.7 then 'fair' else 'poor' end as performance_tier from p where primary_metric is not null""",
)
def perf_tier(spark: SparkSession, sf: str) -> DataFrame:
    found = B.performance_summary(job_log(spark, sf))
    return tidy(found.select("job_id", "primary_metric", "primary_score", "performance_tier"))


@query(
    "newest_jobs",
    f"""with {JOB_LOG} select job_id, algorithm, status from job_log where status = 'completed'
    order by end_time desc, job_id limit 50""",
)
def newest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.newest(job_log(spark, sf), "end_time", "job_id", status="completed")
    return rows.select("job_id", "algorithm", "status")


@query(
    "deployments",
    f"""with {JOB_LOG} select job_id, status, 'active' as origin from job_log where status = 'running'
    union all select job_id, status, 'past' from job_log where status <> 'running'""",
)
def deployments(spark: SparkSession, sf: str) -> DataFrame:
    jobs = job_log(spark, sf).select("job_id", "status")
    active = jobs.filter("status = 'running'").withColumn("origin", F.lit("active"))
    past = jobs.filter("status <> 'running'").withColumn("origin", F.lit("past"))
    return B.all_deployments(active, past)


@query(
    "registry_state",
    """with e as (select user_id as id, event_type as status, case when event_type <> 'view' then value end as progress, ts, event_id
      from events)
    select id, arg_max(status, (ts, event_id)) as status,
      """
    + r("arg_max(progress, (ts, event_id)) filter (progress is not null)")
    + """ as progress, max((ts, event_id))[2] as event_seq from e group by id""",
)
def registry_state(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("status"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("progress"),
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("event_seq"),
    )
    return tidy(registry.current_state(changes, "id", ["event_ts", "event_seq"]).drop("event_ts"))


@query(
    "registry_find",
    "select user_id as id, arg_max(event_type, (ts, event_id)) as status from events where user_id = 42 group by user_id",
)
def registry_find(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "events").filter("user_id = 42").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), "ts", "event_id"
    )
    return registry.current_state(changes, "id", ["ts", "event_id"]).select("id", "status")


@query(
    "registry_joins",
    """select o_orderkey::varchar as id, o_orderstatus as algorithm, o_custkey::varchar as dataset_id, c_name as dataset_name,
      c_mktsegment as dataset_type from orders left join customer on o_custkey = c_custkey""",
)
def registry_joins(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("algorithm"),
        F.col("o_custkey").cast("string").alias("dataset_id"),
    )
    datasets = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("file_type")
    )
    return registry.models_with_datasets(models, datasets)


@query(
    "json_fields",
    """select event_id, (props ->> '$.k')::bigint as k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as packed
    from events""",
)
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = registry.decode_json(table(spark, sf, "events"), "props", "k bigint", "decoded")
    packed = registry.encode_json(df, ["event_type", "user_id"], "packed")
    return packed.select("event_id", F.col("decoded.k").alias("k"), "packed")


@query(
    "parameter_grid",
    """with g as (select a.v as max_depth, b.v as n_estimators from (select distinct l_linenumber as v from lineitem) a,
      (select distinct l_quantity::int as v from lineitem) b),
    k as (select *, md5(max_depth || '|' || n_estimators || '|42') as h from g)
    select cast(row_number() over (order by h) as int) as trial_number, max_depth, n_estimators from k order by h limit 10""",
)
def parameter_grid(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "lineitem").agg(
        F.collect_set("l_linenumber").alias("max_depth"),
        F.collect_set(F.col("l_quantity").cast("int")).alias("n_estimators"),
    )
    return B.parameter_grid(lists, ["max_depth", "n_estimators"])


@query(
    "training_report",
    f"""with {JOB_LOG}, {_BEST}
    select 'best' as part, job_id from (select job_id from v where metric_value is not null
      order by metric_value desc, end_time, job_id limit 20)
    union all select 'history', job_id from (select job_id from job_log order by end_time desc, job_id limit 50)
    union all select 'active', job_id from job_log where status = 'running'""",
)
def training_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report written to the shared folder and read back."""
    path = f"{checkpoint_folder(spark)}/reports/{uuid.uuid4().hex}"
    write_report(B.training_report(spark, job_log(spark, sf)), path)
    parts = {"best": "best_models", "history": "history", "active": "active_jobs"}
    frames = [
        spark.read.parquet(f"{path}/{folder}").select(F.lit(name).alias("part"), "job_id") for name, folder in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "metric_log",
    f"""select 'orders' as source, 'n' as metric, count(*)::double as value from orders
    union all select 'orders', 'total', {r("avg(o_totalprice)")} from orders
    union all select 'customer', 'n', count(*)::double from customer
    union all select 'customer', 'total', {r("avg(c_acctbal)")} from customer""",
)
def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows appended by two evaluations."""
    path = f"{checkpoint_folder(spark)}/metrics/{uuid.uuid4().hex}"
    for name, amount in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n"), F.avg(amount).alias("total"))
        append_results(metric_rows(one, source=name), path)
    return tidy(spark.read.parquet(path).drop("recorded_at"))


@query(
    "text_time_functions",
    """select o_orderkey, lower(o_orderpriority) as priority, split_part(o_orderpriority, '-', 1) as level,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, epoch(o_orderdate)::bigint - epoch(timestamp '1992-01-01')::bigint as seconds
    from orders""",
)
def text_time_functions(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("1992-01-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.lower("o_orderpriority").alias("priority"),
        F.substring_index("o_orderpriority", "-", 1).alias("level"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        F.timestamp_diff("SECOND", start, F.col("o_orderdate")).alias("seconds"),
    )
