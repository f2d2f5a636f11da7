"""Streaming queries: each drains the events table and is compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import checkpoint_folder
from rowmill.operators.missing import fit_impute
from rowmill.operators.scale import fit_scale
from rowmill.operators.steps import Chain
from rowmill.plans.catalog.base import query, r, table, tidy
from rowmill.streaming.serving import alerts, event_stream, job_status, run_to_table, serving_metrics, watch_jobs

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: The copy's files come in any order of time, so rows may be as late as the table is long.
LATENESS = "40 days"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of several micro-batches."""
    path = f"{checkpoint_folder(spark)}/streams/{uuid.uuid4().hex}"
    table(spark, sf, "events").repartition(3).write.parquet(path)
    return event_stream(spark, path, SCHEMA, files_per_trigger=1)


def _metrics(df: DataFrame, interval: str) -> DataFrame:
    latest = serving_metrics(df, F.col("event_type") == "error", F.col("value"), interval=interval, lateness=LATENESS)
    return run_to_table(latest, ["window_start"], "update")


_WINDOWS = """w as (select time_bucket(interval '{i}', ts) as w, count(*) as request_count, avg(value) as response_time,
  avg((event_type = 'error')::int) as error_rate from events group by 1)"""
_START = "strftime(w, '%Y-%m-%d %H:%M:%S') as window_start"


def _text_start(df: DataFrame) -> DataFrame:
    return tidy(df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query(
    "stream_serving_metrics",
    f"""with {_WINDOWS.format(i="60 seconds")} select {_START}, request_count, {r("response_time")} as response_time,
      {r("error_rate")} as error_rate from w""",
)
def stream_serving_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _text_start(_metrics(_stream(spark, sf), "60 seconds"))


@query(
    "stream_alerts",
    f"""with {_WINDOWS.format(i="1 hour")} select {_START}, 'error_rate' as metric, {r("error_rate")} as value,
      0.3::double as "limit" from w where error_rate > 0.3
    union all select {_START}, 'response_time', {r("response_time")}, 60.0::double from w where response_time > 60""",
)
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    metrics = _metrics(_stream(spark, sf), "1 hour")
    limits = {"error_rate": 0.3, "response_time": 60.0}
    return _text_start(alerts(metrics, limits))


@query(
    "stream_score",
    f"""with s as (select avg(value) as m, stddev_pop(value) as d from events)
    select event_id, {r("(value - m) / d")} as value from events, s""",
)
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """A chain fitted on the batch table, applied to the stream."""
    batch = table(spark, sf, "events").select("event_id", "value")
    fill = fit_impute(batch, "mean", protect=["event_id"])
    scale = fit_scale(fill.transform(batch), protect=["event_id"])
    scored = Chain([fill, scale]).transform(_stream(spark, sf).select("event_id", "value"))
    return tidy(run_to_table(scored, None, "append"))


@query(
    "stream_job_status",
    f"""select user_id as job_id, arg_max(event_type, (ts, event_id)) as status, {r("arg_max(value, (ts, event_id))")} as progress
    from events group by user_id""",
)
def stream_job_status(spark: SparkSession, sf: str) -> DataFrame:
    changes = _stream(spark, sf).select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("value").alias("progress"), "ts", "event_id"
    )
    state = job_status(changes, "job_id", ["status", "progress"], ["ts", "event_id"])
    return tidy(run_to_table(state, ["job_id"], "update"))


#: Days of the table that each run of the watched jobs takes.
WATCHED_DAYS = 10
_DAY = 86_400_000_000


@query(
    "stream_job_watch",
    """with c as (select user_id as job_id, ts, event_id, case when event_type = 'error' then 'failed'
        when event_type in ('purchase', 'signup') then 'completed' else 'running' end as status from events),
    l as (select job_id, arg_max(status, (ts, event_id)) as status, max(ts) as t from c group by job_id)
    select job_id, case when status = 'running' and epoch_ms(t) + 6 * 3600000 < (select epoch_ms(max(ts)) - 3600000 from events)
      then 'stuck' else status end as status, strftime(t, '%Y-%m-%d %H:%M:%S') as last_change from l""",
)
def stream_job_watch(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs, fed in order of time: silent for six hours is stuck,
    watermark of one hour.  Each run of the stream goes on where the one before
    stopped."""
    path = f"{checkpoint_folder(spark)}/streams/{uuid.uuid4().hex}"
    rows = table(spark, sf, "events")
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (WATCHED_DAYS * _DAY))
    first, last = rows.agg(F.min(block), F.max(block)).first()
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind.isin("purchase", "signup"), "completed").otherwise("running")
    # The table's span in days, not its rows, sets the number of runs.
    for b in range(first or 0, (last or 0) + 1):
        rows.filter(block == b).write.mode("append").parquet(f"{path}/in")
        stream = event_stream(spark, f"{path}/in", SCHEMA)
        changes = stream.select(F.col("user_id").alias("job_id"), status.alias("status"), "ts", "event_id", "value")
        watched = watch_jobs(changes, "job_id", "status", "ts", "event_id", ["value"], silence="6 hours", lateness="1 hour")
        latest = run_to_table(watched, ["job_id"], "update", f"{path}/out")
    return latest.select("job_id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_change"))
