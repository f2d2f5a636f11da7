"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import urls
from rowmill.llm.registry import query, table


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_pages(spark, pages, table(spark, sf, "labels")))
