"""Dataset, model and job registry as append-only event tables.

An update is one more row holding only the changed fields.  The current state
of an entity is, field by field, the last value that was set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The registry tables and their fields.
SCHEMAS = {
    "datasets": "id string, name string, file_path string, file_type string, metadata string, "
    "created_at timestamp, status string",
    "models": "id string, name string, algorithm string, parameters string, dataset_id string, "
    "file_path string, created_at timestamp, status string, metrics string",
    "searches": "id string, base_config string, param_grid string, job_ids string, total_trials int, best_trial int, "
    "created_at timestamp, status string",
    "jobs": "id string, model_id string, status string, progress double, created_at timestamp, logs string",
}
EVENT_FIELDS = "event_ts timestamp, event_seq bigint"


def _path(root: str, table: str) -> str:
    return f"{root}/{table}"


def record(spark: SparkSession, root: str, table: str, rows: list[dict], seq: int = 0) -> None:
    """Append events; fields a row leaves out keep their earlier value."""
    schema = f"{SCHEMAS[table]}, {EVENT_FIELDS}"
    frame = spark.createDataFrame([{**r, "event_seq": r.get("event_seq", seq)} for r in rows], schema)
    stamped = frame.withColumn("event_ts", F.coalesce("event_ts", F.current_timestamp()))
    append(stamped.withColumn("created_at", F.coalesce("created_at", "event_ts")), _path(root, table))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def events(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMAS[table]}, {EVENT_FIELDS}").parquet(_path(root, table))


def current_state(changes: DataFrame, key: str, order: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Last set value of every field per key; ``first`` fields keep their first.

    A plain aggregate: tasks pre-combine, so a key with millions of updates
    costs one row per task, where a window would sort them all in one.
    """
    fields = [c for c in changes.columns if c != key and c not in order]
    at = F.struct(*order)

    def pick(c: str):
        by = F.when(F.col(c).isNotNull(), at)
        return (F.min_by(c, by) if c in first else F.max_by(c, by)).alias(c)

    return changes.groupBy(key).agg(*[pick(c) for c in fields], F.max(at).alias("_at")).select(
        key, *fields, *[F.col("_at")[o].alias(o) for o in order]
    )


def state(spark: SparkSession, root: str, table: str) -> DataFrame:
    return current_state(events(spark, root, table), "id", ["event_ts", "event_seq"], ("created_at",))


def find(spark: SparkSession, root: str, table: str, key: str) -> DataFrame:
    """One entity; the id filter is pushed down to the scan."""
    only = events(spark, root, table).filter(F.col("id") == key)
    return current_state(only, "id", ["event_ts", "event_seq"], ("created_at",))


def models_with_datasets(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Resolve each model's data set; models without one are kept."""
    named = datasets.select(
        F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), F.col("file_type").alias("dataset_type")
    )
    return models.join(named, "dataset_id", "left")


def jobs_with_models(jobs: DataFrame, models: DataFrame) -> DataFrame:
    named = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "algorithm")
    return jobs.join(named, "model_id")


def decode_json(df: DataFrame, column: str, schema: str, name: str) -> DataFrame:
    return df.withColumn(name, F.from_json(column, schema))


def encode_json(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.to_json(F.struct(*columns)))
