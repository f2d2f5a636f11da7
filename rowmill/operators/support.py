"""Support vector machines by smoothed Newton steps with a duality gap.

Minimises ``penalty / 2 * |w|^2 + mean(max(0, u))``, where u is a row's excess:
``|y - w.z| - epsilon`` in a regression, ``1 - y w.z`` in a classification with
y of 1 or -1.  The kink of max(0, u) is rounded over a width mu (Nesterov,
2005): every row then has a dual variable ``clip(u / mu, 0, 1)`` with the sign of
its pull, and the rounded objective is piecewise quadratic, so Newton steps over
the rows inside the rounding end in few passes.  mu falls whenever its own
problem is solved well enough.  The dual variables give a lower bound of the
exact objective; its distance from the best weights met is the gap, which ends
the search.

Each pass is one Spark job over the rows, and all columns (one per class) share
it: tasks hand over sums of the inputs' size squared, whatever the rows.  A
pass also measures the objective along the step that led to it, so a step
that went too far is shortened in one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.operators.shards import Shards, summed

ROUNDS = 1000
TOL = 1e-3
#: A gap below ``TOL`` times this share of the loss at zero weights is none.
LEAST = 1e-3
#: A rounding counts as solved at this share of the gap, and is then this much of its width.
SOLVED, NARROWER = 0.3, 0.2
#: The narrowest rounding, as a share of the loss at zero weights.
NARROWEST = 1e-14
#: Shares of a step whose objective is measured.
STEPS = np.array([0.0, *2.0 ** np.arange(-20, 1)])
#: Above so many shards the search starts where it ends on the first few, this
#: much wider; the gap is always that over all rows.
MANY, FEW, WIDER = 32, 8, 5.0

# (w.z, y) -> (excess, sign of the pull), per row and column
Excess = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass
class Fitted:
    """``weights`` (the last is the bias) with the least ``primal`` objective met;
    ``gap``: that minus the best dual bound; ``trace``: minus that bound by round;
    ``start``: the loss at zero weights; ``mu``: the last rounding."""

    weights: np.ndarray
    gap: float
    primal: float
    trace: list[float]
    start: float
    mu: float


@dataclass(eq=False)
class _Column:
    """The search of one column: the point ``w`` reached, its step and mu."""

    w: np.ndarray
    step: np.ndarray
    best: np.ndarray | None = None
    mu: float = 1.0
    primal: float = np.inf
    bound: float = -np.inf
    start: float = 0.0
    trace: list[float] = field(default_factory=list)

    @property
    def gap(self) -> float:
        return max(0.0, self.primal - self.bound)


def tube(epsilon: float) -> Excess:
    """Excess of a regression."""

    def excess(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = y - m
        return np.abs(off) - epsilon, np.sign(off)

    return excess


def margin(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Excess of a classification."""
    return 1.0 - y * m, y


def _rounded(u: np.ndarray, mu: np.ndarray) -> np.ndarray:
    return np.where(u < mu, np.maximum(u, 0.0) ** 2 / (2 * mu), u - mu / 2)


def _sums(
    rows: DataFrame, lift: Callable, target: Callable, excess: Excess, size: int, live: list, w: np.ndarray, step: np.ndarray, mu: np.ndarray
) -> np.ndarray:
    """Per ``live`` column: loss, dual terms of the rows that pull up and down,
    squared dual variables, the rounded loss at ``STEPS`` of ``step``, the
    pulls up and down, and the upper triangle of the rows inside the rounding."""
    upper, lead = np.triu_indices(size), 4 + len(STEPS)
    width = lead + 2 * size + size * (size + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, square = np.zeros((w.shape[1], lead + 2 * size)), np.zeros((w.shape[1], size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z, y = lift(x), target(batch.column(1).to_numpy(zero_copy_only=False))[:, live]
            m, moved = z @ w, z @ step
            u, sign = excess(m, y)
            share = np.clip(u / mu, 0.0, 1.0)
            pull = sign * share
            head[:, 0] += np.maximum(u, 0.0).sum(0)
            terms = pull * m + share * u
            head[:, 1] += np.where(sign > 0, terms, 0.0).sum(0)
            head[:, 2] += np.where(sign > 0, 0.0, terms).sum(0)
            head[:, 3] += (share * share).sum(0)
            for i, s in enumerate(STEPS):
                head[:, 4 + i] += _rounded(u if s == 1.0 else excess(m + (s - 1.0) * moved, y)[0], mu).sum(0)
            head[:, lead : lead + size] += np.maximum(pull, 0.0).T @ z
            head[:, lead + size :] += np.minimum(pull, 0.0).T @ z
            for k in range(w.shape[1]):
                inside = z[(u[:, k] > 0) & (u[:, k] < mu[k])]
                square[k] += inside.T @ inside
        flat = np.concatenate([head, square[:, upper[0], upper[1]]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([flat])], ["v"])

    parts = rows.select("x", "y").mapInArrow(run, "v array<double>")
    return summed(parts, "v", w.shape[1] * width).reshape(w.shape[1], width)


def fit_margins(
    rows: DataFrame,
    n: int,
    lift: Callable[[np.ndarray], np.ndarray],
    target: Callable[[np.ndarray], np.ndarray],
    excess: Excess,
    size: int,
    columns: int,
    penalty: float,
    free_bias: bool,
    rounds: int = ROUNDS,
    tol: float = TOL,
    near: list[Fitted] | None = None,
) -> list[Fitted]:
    """One fit per column over ``rows`` (x, y), from the fits ``near`` if given.  ``lift`` maps rows to ``size``
    inputs, the constant 1 last, which ``free_bias`` leaves out of the
    penalty; ``n`` below 0 has the rows counted; ``target`` gives the columns' targets.  Ends at a gap of ``tol``
    times the objective."""
    charge = np.full(size, penalty)
    charge[-1] = 0.0 if free_bias else penalty
    upper, n = np.triu_indices(size), max(1, rows.count() if n < 0 else n)
    every = [_Column(np.zeros(size), np.zeros(size)) for _ in range(columns)]
    for c, found in zip(every, near or []):
        c.w, c.start, c.mu = found.weights, found.start, found.mu * WIDER
    live = list(every)
    for number in range(rounds + 1):
        w, step = (np.column_stack([getattr(c, name) for c in live]) for name in ("w", "step"))
        mu, at = np.array([c.mu for c in live]), [every.index(c) for c in live]
        found = _sums(rows, lift, target, excess, size, at, w + step, step, mu) / n
        still = []
        for c, sums in zip(live, found):
            loss, terms, squares, line = sums[0], sums[1:3], sums[3], sums[4 : 4 + len(STEPS)]
            sides, inside = sums[4 + len(STEPS) :][: 2 * size].reshape(2, size), sums[4 + len(STEPS) + 2 * size :]
            at = c.w + c.step
            primal = loss + float(charge @ (at * at)) / 2
            if not c.start:
                # The first width is wider than the losses at zero weights are on average.
                c.start, c.mu = primal, 2 * primal or 1.0
                c.primal, c.bound, c.best = primal, 0.0, at
                if not primal:
                    c.trace.append(0.0)
                    continue
                still.append(c)
                continue
            if primal < c.primal:
                c.primal, c.best = primal, at
            # The dual bound.  Without a charge on the bias both sides must pull
            # alike: the stronger is weakened.  Then all by the best common factor.
            own, weak = charge > 0, np.ones(2)
            if free_bias:
                force = np.abs(sides[:, -1])
                weak = np.minimum(1.0, force[::-1] / np.maximum(force, 1e-300))
            ends, ties = float(weak @ terms), weak @ sides
            norm = float((ties[own] ** 2 / charge[own]).sum())
            scale = min(1.0, max(0.0, ends) / norm) if norm else 1.0
            c.bound = max(c.bound, scale * ends - scale * scale * norm / 2)
            pulls = sides.sum(0)
            c.trace.append(-c.bound)
            if c.gap <= tol * max(c.primal, LEAST * c.start) or number == rounds or c.mu < NARROWEST * c.start:
                continue
            still.append(c)
            points = c.w[:, None] + STEPS * c.step[:, None]
            values = line + (charge[:, None] * points * points).sum(0) / 2
            least = int(np.argmin(values))
            reached = values[STEPS == 1.0][0]
            if c.step.any() and reached > values[0] - 0.5 * (values[0] - values[least]):
                if STEPS[least] > 0:
                    c.step = c.step * STEPS[least]
                    continue
                # No share of the step gains: this rounding is solved as far as doubles go.
                at, solved = c.w, True
            else:
                solved = reached - (ends - squares * c.mu / 2 - norm / 2) <= SOLVED * (primal - (ends - norm / 2))
            c.w = at
            if solved:
                c.mu, c.step = c.mu * NARROWER, np.zeros(size)
                continue
            half = np.zeros((size, size))
            half[upper] = inside / c.mu
            # The bias is damped, since no row may lie inside the rounding.
            curve = half + half.T - np.diag(np.diag(half)) + penalty * np.eye(size)
            ridge = 1e-13 * max(float(np.trace(curve)) / size, 1e-300)
            c.step = np.linalg.solve(curve + ridge * np.eye(size), pulls - charge * c.w)
        live = still
        if not live:
            break
    return [Fitted(c.best, float(c.gap), float(c.primal), c.trace, c.start, c.mu) for c in every]


def _fit(shards: Shards, lift: Callable, target: Callable, excess: Excess, size: int, columns: int, *rest) -> list[Fitted]:
    near = None
    if shards.count > MANY:
        near = fit_margins(shards.rows.filter(F.col("shard") < FEW), -1, lift, target, excess, size, columns, *rest)
        near = near if all(c.start for c in near) else None
    return fit_margins(shards.rows, shards.n, lift, target, excess, size, columns, *rest, near)


def fit_svr(
    shards: Shards,
    lift: Callable[[np.ndarray], np.ndarray],
    size: int,
    scale: tuple[float, float],
    C: float = 1.0,
    epsilon: float = 0.1,
    rounds: int = ROUNDS,
    tol: float = TOL,
) -> Fitted:
    """The target is centred and scaled by ``scale``, and ``C`` and ``epsilon``
    hold for it as it was before; the bias is penalised like the weights."""
    centre, width = scale
    penalty = width / C / max(1, shards.n)

    def target(y: np.ndarray) -> np.ndarray:
        return ((y - centre) / width)[:, None]

    return _fit(shards, lift, target, tube(epsilon / width), size, 1, penalty, False, rounds, tol)[0]


def fit_svc(
    shards: Shards, lift: Callable[[np.ndarray], np.ndarray], size: int, classes: int, C: float = 1.0, rounds: int = ROUNDS, tol: float = TOL
) -> list[Fitted]:
    """A plane per class against the others, or one for the second of two; y is
    the number of the class.  The bias is free of penalty."""
    own = np.array([1.0]) if classes == 2 else np.arange(float(classes))

    def target(y: np.ndarray) -> np.ndarray:
        return np.where(y[:, None] == own, 1.0, -1.0)

    return _fit(shards, lift, target, margin, size, len(own), 1.0 / (C * max(1, shards.n)), True, rounds, tol)
