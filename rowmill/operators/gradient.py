"""Data-parallel training of the network regressor.

Every loss evaluation is one Spark job: each task runs numpy over its own
batches and hands over a single gradient vector, the vectors are summed on the
executors, and only their sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import number
from rowmill.operators.shards import summed

#: Steps of small gain in a row that end the training.
PATIENCE = 10

# (x, y, w) -> (summed loss, summed gradient)
BatchLoss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def fourier_map(width: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random Fourier features of the RBF kernel (Rahimi & Recht, 2007)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (width, size)), rng.uniform(0.0, 2.0 * np.pi, size)


def fourier(x: np.ndarray, freq: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phase)) * np.cos(x @ freq + phase)


def network_shapes(width: int, hidden: list[int]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def _layers(w: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in shapes:
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def network_output(x: np.ndarray, w: np.ndarray, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Activations of every layer; ReLU inside, linear at the end."""
    acts = [x]
    for i, (m, b) in enumerate(_layers(w, shapes)):
        z = acts[-1] @ m + b
        acts.append(z if i == len(shapes) - 1 else np.maximum(z, 0.0))
    return acts


def squared_loss(shapes: list[tuple[int, int]]) -> BatchLoss:
    def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        acts = network_output(x, w, shapes)
        delta = acts[-1] - y[:, None]
        total = float((delta * delta).sum()) / 2
        grads = []
        for i, (m, _) in reversed(list(enumerate(_layers(w, shapes)))):
            grads.append(np.concatenate([(acts[i].T @ delta).ravel(), delta.sum(0)]))
            if i:
                delta = (delta @ m.T) * (acts[i] > 0)
        return total, np.concatenate(grads[::-1])

    return loss


def initial_network(shapes: list[tuple[int, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes:
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


@dataclass
class Standardised:
    """Column means and deviations used inside the solver."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, columns: list[str]) -> Standardised:
        row = df.agg(
            *[F.struct(F.avg(number(df, c)), F.stddev_pop(number(df, c))).alias(f"s{i}") for i, c in enumerate(columns)]
        ).first()
        return cls(np.array([r[0] or 0.0 for r in row]), np.array([r[1] or 1.0 for r in row]))


def _task_gradient(loss: BatchLoss, w: np.ndarray, scale: Standardised):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, grad, rows = 0.0, np.zeros_like(w), 0
        for batch in batches:
            data = (batch.to_numpy(dtype=np.float64) - scale.mean) / scale.std
            part, g = loss(data[:, :-1], data[:, -1], w)
            total, grad, rows = total + part, grad + g, rows + len(data)
        if rows:
            yield pd.DataFrame({"g": [np.concatenate([[rows, total], grad])]})

    return run


def train(
    df: DataFrame,
    features: list[str],
    target: str,
    loss: BatchLoss,
    start: np.ndarray,
    penalty: float,
    max_iter: int = 100,
    tol: float = 1e-4,
) -> tuple[np.ndarray, Standardised, list[float]]:
    """Minimise mean loss + penalty/2 * |w|^2 by L-BFGS over Spark jobs.

    Ends after ``PATIENCE`` steps in a row that each gain less than ``tol``.
    Returns weights, the scaling (target last) and the loss after each step.
    """
    columns = [*features, target]
    table = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scale = Standardised.of(table, table.columns)

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
            parts = table.mapInPandas(_task_gradient(loss, w, scale), "g array<double>")
            flat = summed(parts, "g", len(w) + 2)
            n = max(1.0, flat[0])
            return flat[1] / n + penalty / 2 * float(w @ w), flat[2:] / n + penalty * w

        w, trace = _lbfgs(evaluate, start, max_iter, tol)
        return w, scale, trace
    finally:
        table.unpersist()


def _lbfgs(evaluate, w: np.ndarray, max_iter: int, tol: float, memory: int = 8):
    """Limited-memory BFGS with backtracking (Nocedal & Wright, ch. 7)."""
    value, grad = evaluate(w)
    trace = [value]
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    small = 0
    for _ in range(max_iter):
        if np.abs(grad).max() < 1e-8:
            break
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * (y @ q))
        slope = -(grad @ q)
        if slope >= 0:
            q, slope, past = grad, -(grad @ grad), []
        step = 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            new_value, new_grad = evaluate(w - step * q)
            if new_value <= value + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        if step < 1e-8:
            break
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-12:
            past = [*past, (s, y, 1.0 / (s @ y))][-memory:]
        small = small + 1 if value - new_value < tol * max(1.0, abs(value)) else 0
        w, value, grad = w - step * q, new_value, new_grad
        trace.append(value)
        if small >= PATIENCE:
            break
    return w, trace
