"""K-means with all restarts in one pass per step.

Each pass is one Spark job over the written vectors: tasks assign every row for
every restart that still moves and hand over sums, which are added on the
executors.  Starting centres are drawn for all restarts together, one pass per
centre: a row's chance is its squared distance from the centres drawn so far, and
the draw is a race of hashed exponentials, so a task that runs again draws the
same row.

Defined results: rows with a missing component take no part in the fit; of
equally near centres the first; an empty cluster keeps its centre; fewer distinct
rows than clusters leave repeated centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.operators.shards import summed
from rowmill.operators.trees import _uniform

#: Values of a batch held in memory together with its distances.
BATCH_VALUES = 1 << 20


@dataclass
class Fit:
    """``steps`` of the best restart; ``inertias`` of all."""

    centres: np.ndarray
    inertia: float
    steps: int
    inertias: list[float]


def numbered(vectors: DataFrame) -> DataFrame:
    """``(row, x)`` of the whole rows, written."""
    typed = vectors.select(F.monotonically_increasing_id().alias("row"), vector_to_array("features").alias("x"))
    return settle(typed.filter(~F.exists("x", lambda v: F.isnan(v))))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, BATCH_VALUES // max(1, width))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield batch.column(0).to_numpy(), x


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by differences, so equal rows are at 0."""
    out = np.empty((len(x), len(centres)))
    for c, centre in enumerate(centres):
        off = x - centre
        out[:, c] = np.einsum("ij,ij->i", off, off)
    return out


def _drawn(rows: DataFrame, centres: list[np.ndarray], seed: int, width: int, uniform: bool) -> list[np.ndarray]:
    """The next centre of every restart."""
    count, step = len(centres), len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * count
        for number, x in _blocks(batches, width):
            for r in range(count):
                u = _uniform(number, seed * 7919 + r * 104729 + step)
                chance = np.ones(len(x)) if uniform or not step else distances(x, centres[r]).min(1)
                # A row already drawn has no chance while another one is left.
                race = np.where(chance > 0, -np.log1p(-u) / np.maximum(chance, 1e-300), np.inf)
                i = int(np.lexsort((number, race))[0])
                if best[r] is None or (race[i], number[i]) < best[r][:2]:
                    best[r] = (race[i], number[i], x[i])
        kept = [(r, *b) for r, b in enumerate(best) if b is not None]
        names = ["restart", "race", "row", "x"]
        columns = [pa.array([k[i] for k in kept], t) for i, t in enumerate([pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())])]
        yield pa.RecordBatch.from_arrays(columns, names)

    found = rows.mapInArrow(run, "restart int, race double, row long, x array<double>")
    # One row per restart.
    first = found.groupBy("restart").agg(F.min(F.struct("race", "row", "x")).alias("b")).collect()
    picked = {r["restart"]: np.array(r["b"]["x"]) for r in first}
    return [np.vstack([c, picked[r]]) for r, c in enumerate(centres)]


def _step(rows: DataFrame, centres: list[np.ndarray], k: int, width: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per restart the clusters' sums, sizes and the inertia."""
    count, size = len(centres), k * width + k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, size))
        for _, x in _blocks(batches, width):
            for r in range(count):
                far = distances(x, centres[r])
                near = far.argmin(1)
                member = np.zeros((k, len(x)))
                member[near, np.arange(len(x))] = 1.0
                total[r, : k * width] += (member @ x).ravel()
                total[r, k * width : -1] += member.sum(1)
                total[r, -1] += far[np.arange(len(x)), near].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["v"])

    flat = summed(rows.mapInArrow(run, "v array<double>"), "v", count * size).reshape(count, size)
    return [(f[: k * width].reshape(k, width), f[k * width : -1], float(f[-1])) for f in flat]


def fit_kmeans(
    rows: DataFrame,
    k: int,
    restarts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
    seed: int = 42,
    init: str | np.ndarray = "k-means++",
) -> Fit:
    """The restart of least inertia.  One ends when its centres move, squared and
    summed, by at most ``tol`` times the mean variance, or after ``max_iter`` steps."""
    parts = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v"))
    variances = [r["v"] for r in parts.collect()]  # one row per component
    width, still = max(1, len(variances)), tol * float(np.mean(variances or [0.0]))
    if isinstance(init, str):
        centres = [np.empty((0, width)) for _ in range(restarts)]
        for _ in range(k if variances else 0):
            centres = _drawn(rows, centres, seed, width, init == "random")
    else:
        centres = [np.array(init, float)]
    if not variances:
        return Fit(np.zeros((k, width)), 0.0, 0, [0.0])
    steps, inertias, live = [0] * len(centres), [np.inf] * len(centres), list(range(len(centres)))
    while live:
        found = _step(rows, [centres[r] for r in live], k, width)
        moving = []
        for r, (sums, sizes, inertia) in zip(live, found):
            inertias[r] = inertia
            moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1.0)[:, None], centres[r])
            shift = float(((moved - centres[r]) ** 2).sum())
            # The inertia is that of the centres before; a restart at rest keeps them.
            if steps[r] < max_iter and shift > still:
                centres[r], steps[r] = moved, steps[r] + 1
                moving.append(r)
        live = moving
    best = int(np.argmin(inertias))
    return Fit(centres[best], inertias[best], steps[best], inertias)
