"""Query of the edit-aware token counts."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowmill.llm.registry import query, table
from rowmill.llm.tokencount import Edit, build, recount

_LONG_NUMBER = re.compile(r"[0-9]{5,}")
MASK = "<number>"


def cleaning_edits(text: str) -> list[Edit]:
    """Edits a cleaning step makes: repeated lines of a text go, with the line
    break before them, and long numbers are masked."""
    seen: set[str] = set()
    out: list[Edit] = []
    at = 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            out.extend((at + m.start(), at + m.end(), MASK) for m in _LONG_NUMBER.finditer(line))
        at += len(line) + 1
    return out


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = build(table(spark, sf, "documents"), ranks, pattern)
    return recount(trees, cleaning_edits, ranks, pattern).drop("leaf_chars", "leaf_tokens")
