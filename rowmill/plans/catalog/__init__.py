"""The registered queries: name -> Spark callable, name -> oracle SQL."""

from rowmill.plans.catalog.base import ORACLES, QUERIES
from rowmill.plans.catalog import (  # noqa: E402,F401  (registration by import)
    board,
    files,
    learning,
    metrics,
    preparation,
    profiling,
    solvers,
    streams,
)

__all__ = ["ORACLES", "QUERIES"]
