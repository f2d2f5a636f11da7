"""Table and result writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col


def write_table(df: DataFrame, path: str, file_type: str = "parquet", mode: str = "overwrite") -> str:
    """CSV doubles quotes inside values, as the reader expects."""
    writer = df.write.mode(mode)
    if file_type == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    elif file_type == "json":
        writer.json(path)
    elif file_type == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for file type {file_type!r}")
    return path


def metric_rows(df: DataFrame, **tags: str) -> DataFrame:
    """A one-row metric table as ``(tags..., metric, value)`` rows."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "bigint", "int", "long")]
    pairs: Column = F.array(
        *[F.struct(F.lit(c).alias("metric"), col(c).cast("double").alias("value")) for c in numbers]
    )
    tagged = [F.lit(v).alias(k) for k, v in tags.items()]
    return df.select(*tagged, F.inline(pairs))


def append_results(df: DataFrame, path: str) -> None:
    """Append result rows, stamped with the time of writing."""
    df.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")
