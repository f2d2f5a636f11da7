"""Principal components of wide tables by randomised block power iteration.

A block of random directions is multiplied by the covariance, one pass over the
rows a step, until the wanted components no longer move.  Tasks and driver hold
that block, which grows with the columns alone; no square matrix is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.operators.shards import summed

#: Directions beside the wanted ones, which make the iteration converge.
SPARE = 10
MOST_STEPS = 100
#: Least part of the first variance that a component may still be off by.
TOLERANCE = 1e-7


@dataclass
class Components:
    """``loadings``: columns x k.  ``residual`` is the largest of
    ``|C v - variance v|`` over the first variance."""

    mean: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    total: float
    residual: float
    steps: int


def _product(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The scatter matrix times ``block``, summed over the rows of all tasks."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(block.shape)
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=np.float64).reshape(len(batch), -1) - mean
            out += x.T @ (x @ block)
        yield pd.DataFrame({"part": [out.ravel()]})

    parts = rows.select("x").mapInPandas(multiply, "part array<double>")
    return summed(parts, "part", block.size).reshape(block.shape)


def principal(
    vectors: DataFrame, features: str, k: int, seed: int, steps: int = MOST_STEPS, tolerance: float = TOLERANCE
) -> Components:
    """The first ``k`` components of the rows without a missing value.

    Fewer columns or rows than ``k`` give fewer components; fewer than two rows
    are an error, since they have no variance.
    """
    x = vector_to_array(features).alias("x")
    rows = settle(vectors.select(x).filter(~F.exists("x", lambda v: F.isnan(v))))
    n = rows.count()
    if n < 2:
        raise ValueError("components need two rows without missing values")
    found = rows.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")).first()["s"]
    mean = found["mean"].toArray()
    total, width = float(found["variance"].toArray().sum()), len(mean)
    k = min(k, width, n)
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + SPARE))))
    for step in range(1, steps + 1):
        image = _product(rows, mean, block) / (n - 1)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors_now = block @ turn
        off = np.linalg.norm(image @ turn[:, :k] - vectors_now[:, :k] * values[:k], axis=0).max()
        residual = float(off / values[0]) if values[0] > 0 else 0.0
        if residual <= tolerance:
            break
        block, _ = np.linalg.qr(image)
    return Components(mean, vectors_now[:, :k], np.maximum(values[:k], 0.0), total, residual, step)
