"""Streaming scoring, serving metrics, alerts and job status."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowmill.functions.storage import checkpoint_folder

# Fixed value: the reporting interval when none is given.
INTERVAL = "60 seconds"
# The states a job ends in.
FINISHED = ("completed", "failed")
#: Status of a job that has not reported for too long.
STUCK = "stuck"


def event_stream(
    spark: SparkSession, path: str, schema: str, time: str = "ts", files_per_trigger: int | None = None
) -> DataFrame:
    """A Parquet folder or file as a stream; NTZ times become timestamps,
    since watermarks need them.

    The path is given as a pattern, because a stream accepts a single file
    only through one.
    """
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def serving_metrics(
    requests: DataFrame,
    error: Column,
    latency: Column,
    time: str = "ts",
    interval: str = INTERVAL,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Requests, mean latency and error rate per tumbling interval.

    Runs on batches and on streams; on streams, rows later than ``lateness``
    are dropped and the state of closed windows is released.
    """
    if requests.isStreaming:
        requests = requests.withWatermark(time, lateness)
    return (
        requests.groupBy(F.window(time, interval).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.avg(latency).alias("response_time"),
            F.avg(error.cast("double")).alias("error_rate"),
        )
        .select(F.col("w.start").alias("window_start"), "request_count", "response_time", "error_rate")
    )


def alerts(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per window and metric above its limit."""
    checks = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(v)).alias("limit")
            )
            for m, v in limits.items()
        ]
    )
    return metrics.select("window_start", F.explode(checks).alias("c")).select("window_start", "c.*").filter(
        "value > limit"
    )


def job_status(changes: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """Latest status per job.  State is one row per job."""
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
    return changes.groupBy(key).agg(last).select(key, *[F.col(f"s.{f}").alias(f) for f in fields])


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def watch_jobs(
    changes: DataFrame,
    key: str,
    status: str,
    time: str,
    order: str,
    fields: list[str],
    finished: tuple[str, ...] = FINISHED,
    silence: str = "1 hour",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Status changes of jobs as a stream, with bounded state.

    Per micro-batch and job: its latest row by ``(time, order)`` as key,
    ``status``, ``time`` and ``fields``.  A job that has not reported for
    ``silence`` of event time is told once as ``stuck`` and leaves the state.
    A finished job leaves it as soon as the watermark has passed its last row,
    so no earlier row can bring it back; a job that reports again later starts
    anew.  State is one row per job that is running or has just finished.

    Rows later than ``lateness`` are dropped, as are rows without a key, time
    or order.  A NULL status is an unfinished one.
    """
    wait = _milliseconds(silence)
    if wait <= 0:
        raise ValueError("silence must be longer than nothing")
    kept = [key, status, time, *fields]
    typed = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    schema = ", ".join(f"`{c}` {typed[c]}" for c in kept)
    # Microseconds and order decide between rows; both survive a state round trip.
    state_schema = f"_at bigint, _order bigint, `{status}` string, " + ", ".join(f"`{f}` {typed[f]}" for f in fields)

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(at: int, text: str | None, rest: tuple) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(kept, ([v] for v in (group[0], text, pd.Timestamp(at, unit="us"), *rest)))))

        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            at, _, text, *rest = state.get
            state.remove()
            if text not in finished:
                yield told(at, STUCK, tuple(rest))
            return
        best = state.get if state.exists else None
        before = best
        for frame in frames:
            # Most calls hold a few rows, where a sort by pandas costs more than all else.
            ats, orders = frame["_at"].tolist(), frame["_order"].tolist()
            last = max(range(len(ats)), key=lambda i: (ats[i], orders[i], i), default=None)
            if last is not None and ats[last] // 1000 >= now:
                cells = [frame[c].tolist()[last] for c in (status, *fields)]
                new = (ats[last], orders[last], *[None if pd.isna(v) else v for v in cells])
                best = new if best is None or new[:2] >= best[:2] else best
        if best is None:
            return
        state.update(tuple(best))
        ends = best[0] // 1000 + (0 if best[2] in finished else wait)
        state.setTimeoutTimestamp(max(ends, now + 1))
        if best is not before:
            yield told(best[0], best[2], tuple(best[3:]))

    whole = changes.withColumn(time, F.col(time).cast("timestamp"))
    stamped = whole.withWatermark(time, lateness).filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull())
    asked = stamped.select(
        key, F.col(status).cast("string").alias(status), time, *fields, F.unix_micros(time).alias("_at"), F.col(order).cast("long").alias("_order")
    )
    return asked.groupBy(key).applyInPandasWithState(
        follow, schema, state_schema, "update", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(stream: DataFrame, key: list[str] | None, mode: str = "update", path: str | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder and read it back.

    Every micro-batch overwrites its own folder, so a retried batch leaves no
    duplicates.  In update mode ``key`` is needed, and the latest batch of each
    key is read.  In complete mode each batch is the whole result and replaces
    the one before.
    """
    if mode == "update" and not key:
        raise ValueError("update mode needs the key of a row")
    spark = stream.sparkSession
    path = path or f"{checkpoint_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        place = 0 if mode == "complete" else batch_id
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={place}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/rows")
    if key is None or mode == "complete":
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return latest.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])
