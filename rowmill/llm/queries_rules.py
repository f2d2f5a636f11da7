"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import rules
from rowmill.llm.registry import query, table


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents"))
