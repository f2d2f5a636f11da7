"""Query of the near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.neardup import near_duplicates
from rowmill.llm.registry import query, table


@query("op5_minhash_neardup")
def op5_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"), size=3, percent=85)
