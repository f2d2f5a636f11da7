"""Query of the benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.decontaminate import leaks
from rowmill.llm.registry import query, table


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("row")
