"""All queries of this package: name -> Spark callable, name -> oracle SQL."""

from rowmill.llm.registry import ORACLES, QUERIES
from rowmill.llm import (  # noqa: E402,F401  (registration by import)
    queries_bitplanes,
    queries_chat,
    queries_collocations,
    queries_decontaminate,
    queries_licenses,
    queries_lines,
    queries_mixing,
    queries_neardup,
    queries_packing,
    queries_quality,
    queries_rules,
    queries_tokencount,
    queries_urls,
)

__all__ = ["ORACLES", "QUERIES"]
