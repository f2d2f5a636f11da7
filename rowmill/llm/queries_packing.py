"""Query of the packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.packing import pack_documents
from rowmill.llm.registry import query, table


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"), tokenizer())
