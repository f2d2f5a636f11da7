"""Classifier networks: mini-batch Adam over sharded rows.

ReLU layers, softmax cross-entropy, an L2 penalty and dropout.  Each epoch is one
Spark job: every shard starts from the shared weights and moments, takes Adam
steps over its own batches, and the shards' states are averaged by their rows on
the executors; only the averaged state reaches the driver.  A table of one shard
runs many epochs in a job, which is plain Adam.

From ``FEW_SHARDS`` shards on, shards are longer, a task takes its lane of shards
one after the other (an epoch takes more steps, so fewer epochs are needed) and
steps are taken in single precision; the lanes' states are averaged in double.
The lanes are as many as the cores, so such a fit depends on their number.

Batches and dropout masks come from a generator keyed by seed, epoch, shard and
place in it, so a task that runs again takes the same steps.  Training
ends when the loss has not fallen by ``tol`` for ``PATIENCE`` epochs in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from rowmill.operators.gradient import _layers, initial_network
from rowmill.operators.shards import Shards, local, summed, unpack

BATCH = 200
RATE = 1e-3
BETA1, BETA2, TINY = 0.9, 0.999, 1e-8
PATIENCE = 10
#: The least probability whose logarithm is taken in single precision.
LEAST = np.finfo(np.float32).tiny
#: Epochs in one job where there is a single shard.
EPOCHS_PER_JOB = 50


@dataclass(frozen=True)
class Net:
    """``dropout``: share of each hidden layer's outputs left out in training."""

    shapes: tuple[tuple[int, int], ...]
    alpha: float = 1e-4
    dropout: tuple[float, ...] = ()
    rate: float = RATE
    batch: int = BATCH
    seed: int = 42


@dataclass
class Patience:
    """Counts epochs without a gain of ``tol``."""

    tol: float
    best: float = np.inf
    stale: int = 0
    trace: list[float] = field(default_factory=list)

    def over(self, loss: float) -> bool:
        self.trace.append(loss)
        self.stale = self.stale + 1 if loss > self.best - self.tol else 0
        self.best = min(self.best, loss)
        return self.stale > PATIENCE


def probabilities(x: np.ndarray, w: np.ndarray, shapes) -> np.ndarray:
    for i, (m, b) in enumerate(_layers(w, shapes)):
        x = x @ m + b
        if i < len(shapes) - 1:
            x = np.maximum(x, 0.0)
    return _softmax(x)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def batch_loss(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, net: Net, draw: np.random.Generator | None = None
) -> tuple[float, np.ndarray]:
    """Mean cross-entropy plus ``alpha / (2 n)`` times the squared weights (biases
    apart), and its gradient; with ``draw``, under dropout."""
    layers = _layers(w, net.shapes)
    acts, masks = [x], []
    for i, (m, b) in enumerate(layers):
        z = acts[-1] @ m + b
        if i < len(layers) - 1:
            z = np.maximum(z, 0.0)
            off = net.dropout[i] if draw is not None and i < len(net.dropout) else 0.0
            masks.append((draw.random(z.shape, z.dtype) >= off).astype(z.dtype) / (1.0 - off) if off else None)
            z = z if masks[-1] is None else z * masks[-1]
        acts.append(z)
    n, rows = len(x), np.arange(len(x))
    p = _softmax(acts[-1])
    loss = float(-np.log(np.maximum(p[rows, y], max(1e-300, np.finfo(p.dtype).tiny))).sum()) / n
    delta = p
    delta[rows, y] -= 1.0
    delta /= n
    grads = []
    for i, (m, _) in reversed(list(enumerate(layers))):
        loss += net.alpha / (2 * n) * float((m * m).sum())
        grads.append(np.concatenate([(acts[i].T @ delta + net.alpha / n * m).ravel(), delta.sum(0)]))
        if i:
            delta = (delta @ m.T) * (acts[i] > 0)
            delta = delta if masks[i - 1] is None else delta * masks[i - 1]
    return loss, np.concatenate(grads[::-1])


def epoch(x: np.ndarray, y: np.ndarray, state: list, net: Net, number: int, shard: int) -> float:
    """One pass of Adam; ``state`` is [w, first moment, second moment, steps]."""
    draw = np.random.Generator(np.random.Philox(key=[net.seed, shard], counter=[0, 0, 0, number]))
    order, total = draw.permutation(len(x)), 0.0
    for at in range(0, len(x), net.batch):
        rows = order[at : at + net.batch]
        loss, g = batch_loss(x[rows], y[rows], state[0], net, draw)
        total += loss * len(rows)
        state[3] += 1
        state[1] = BETA1 * state[1] + (1 - BETA1) * g
        state[2] = BETA2 * state[2] + (1 - BETA2) * g * g
        rate = float(net.rate * np.sqrt(1 - BETA2 ** state[3]) / (1 - BETA1 ** state[3]))
        state[0] = state[0] - rate * state[1] / (np.sqrt(state[2]) + TINY)
    return total / len(x)


class Steps:
    """Adam in single precision and in place: what ``epoch`` does, without new
    arrays in each step.  Inputs and outputs are held by columns, with a last one
    of ones for the biases; a mask's share is that of ``dropout`` in 1 / 65,536."""

    def __init__(self, state: list, net: Net):
        self.net, self.number = net, float(state[3])
        self.w, self.first, self.second = (np.array(v, np.float32) for v in state[:3])
        self.grad, self.held, self.decay = (np.zeros_like(self.w) for _ in range(3))
        # Weights with the biases as their last row.
        ends = np.cumsum([(a + 1) * b for a, b in net.shapes])[:-1]
        self.layers, self.grads = (
            [part.reshape(-1, b) for part, (_, b) in zip(np.split(v, ends), net.shapes)] for v in (self.w, self.grad)
        )
        for m, _ in _layers(self.decay, net.shapes):
            m[:] = net.alpha
        self.hidden = [b for _, b in net.shapes[:-1]]
        self.off = [round(65536 * o) for o in (*net.dropout, *[0] * len(self.hidden))][: len(self.hidden)]
        self.noise = sum(b for b, off in zip(self.hidden, self.off) if off)
        self.room(net.batch)

    def room(self, n: int) -> None:
        """Buffers for batches of ``n`` rows."""
        self.rows = np.arange(n)
        self.out = [np.ones((b + 1, n), np.float32) for b in self.hidden]
        self.back, self.mask, self.keep, self.drawn = (
            [np.empty((b, n), k) for b in self.hidden] for k in (np.float32, np.float32, bool, bool)
        )

    def gradient(self, x: np.ndarray, y: np.ndarray, draw: np.random.BitGenerator) -> float:
        """Sets ``grad`` from a batch's columns; its mean loss as ``batch_loss`` gives it."""
        n, at, acts = len(y), 0, [x, *self.out]
        bits = draw.random_raw(-(-n * self.noise // 4)).view(np.uint16) if self.noise else None
        for i, off in enumerate(self.off):
            z = np.matmul(self.layers[i].T, acts[i], out=self.out[i][:-1])
            keep = np.greater(z, 0, out=self.keep[i])
            if off:
                keep &= np.greater_equal(bits[at : at + z.size].reshape(z.shape), off, out=self.drawn[i])
                at += z.size
            z *= np.multiply(keep, np.float32(65536 / (65536 - off)), out=self.mask[i])
        p = self.layers[-1].T @ acts[-1]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        decay = np.multiply(self.decay, self.w, out=self.held)
        own, flat = y * n + self.rows, p.ravel()
        loss = (float(-np.log(np.maximum(flat.take(own), LEAST)).sum()) + float(decay @ self.w) / 2) / n
        flat[own] -= 1
        p /= n
        delta = p
        for i in reversed(range(len(self.layers))):
            np.matmul(acts[i], delta.T, out=self.grads[i])
            if i:
                delta = np.matmul(self.layers[i][:-1], delta, out=self.back[i - 1])
                delta *= self.mask[i - 1]
        decay /= n
        self.grad += decay
        return loss

    def step(self) -> None:
        self.number += 1
        for moment, new, keep in ((self.first, self.grad, BETA1), (self.second, None, BETA2)):
            new = np.multiply(self.grad, self.grad, out=self.held) if new is None else new
            change = np.subtract(new, moment, out=self.held)
            change *= np.float32(1 - keep)
            moment += change
        move = np.sqrt(self.second, out=self.held)
        move += np.float32(TINY)
        np.divide(self.first, move, out=move)
        move *= np.float32(self.net.rate * np.sqrt(1 - BETA2**self.number) / (1 - BETA1**self.number))
        self.w -= move

    def run(self, x: np.ndarray, y: np.ndarray, key: list[int]) -> float:
        """One pass; the summed loss."""
        draw, size, total = np.random.SFC64(key), self.net.batch, 0.0
        order = np.random.Generator(draw).permutation(len(x))
        x, y = np.vstack([x.take(order, 0).T, np.ones(len(x), np.float32)]), y.take(order).astype(np.intp)
        for at in range(0, len(y), size):
            part = y[at : at + size]
            if len(part) != len(self.rows):
                self.room(len(part))
            total += self.gradient(x[:, at : at + size], part, draw) * len(part)
            self.step()
        return total


def _lanes(shards: Shards, net: Net, state: list, number: int):
    """Per lane its state times its rows after one pass over its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, loss = Steps(state, net), 0, 0.0
        for batch in batches:
            for shard, at, x, y in unpack(batch, net.shapes[0][0]):
                loss, n = loss + own.run(x, y, [net.seed, number, shard, at]), n + len(x)
        if n:
            parts = np.concatenate([[1.0, loss / n, own.number], own.w, own.first, own.second], dtype=np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([parts])], ["v"])

    return shards.rows.mapInArrow(run, "v array<double>")


def _job(shards: Shards, net: Net, state: list, first: int, epochs: int, patience: Patience):
    """Per shard its state times its rows, and the loss of each epoch."""
    mean, std = shards.mean, shards.std

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = local(table)
        x, y = (x - mean) / std, y.astype(np.int64)
        own, known, losses = list(state), Patience(patience.tol, patience.best, patience.stale), []
        for number in range(first, first + epochs):
            losses.append(epoch(x, y, own, net, number, key[0].as_py()))
            if epochs > 1 and known.over(losses[-1]):
                break
        parts = np.concatenate([[1.0, losses[-1], own[3]], own[0], own[1], own[2]]) * len(x)
        return pa.table({"v": pa.array([parts]), "losses": pa.array([losses])})

    return shards.rows.groupBy("shard").applyInArrow(run, "v array<double>, losses array<double>")


def fit_network(shards: Shards, net: Net, max_iter: int, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Weights, and the loss of each epoch."""
    w = initial_network(list(net.shapes), net.seed)
    state, patience, number = [w, np.zeros_like(w), np.zeros_like(w), 0.0], Patience(tol), 0
    while shards.n and number < max_iter:
        epochs = min(EPOCHS_PER_JOB, max_iter - number) if shards.count == 1 else 1
        parts = _lanes(shards, net, state, number) if shards.lanes else _job(shards, net, state, number, epochs, patience)
        if shards.count == 1:
            row = parts.collect()[0]
            flat, losses = np.array(row["v"]), row["losses"]
        else:
            flat = summed(parts, "v", 3 * len(w) + 3)
            losses = [flat[1] / flat[0]]
        flat, size = flat / flat[0], len(w)
        state = [flat[3 : 3 + size], flat[3 + size : 3 + 2 * size], flat[3 + 2 * size :], float(flat[2])]
        number += len(losses)
        if any([patience.over(loss) for loss in losses]):
            break
    return state[0], patience.trace
