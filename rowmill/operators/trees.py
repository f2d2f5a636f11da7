"""Decision trees and forests with exact splits.

Every distinct value of a feature is a possible split; its threshold is half-way
to the next.  Large nodes are split level by level over the whole table, in two
passes.  The first sums up quantile ranges of each feature: the splits between
ranges are known then, and the worth of a split inside a range is bounded, since
worth is convex in the sums of a side.  The second counts labels per (tree, node,
feature, value) inside the ranges whose bound reaches the best known split;
running totals in value order give both sides of each split there, and one best
split per node reaches the driver.  Nodes whose rows fit ``LOCAL_BYTES`` are finished by one task each, in memory.

A forest draws each row's weight per tree from a hash of its number (Poisson,
as a bootstrap of a large table) and each node's features from a hash of its
place.  With ``bins`` the large nodes of a forest take the values of a feature by
so many quantile ranges: a task adds up all its rows' sums per range before they
are shuffled, and the rows of smaller nodes are shuffled once, packed by node, a
few trees at a time, so the disk they take does not grow with the trees.

Defined results: of equal splits the first feature, then the lowest threshold;
missing values go right; a node splits while it is impure, has
``min_samples_split`` rows, and both sides keep ``min_samples_leaf``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.storage import drop_shuffles

#: A node of this size is finished by one task.
LOCAL_BYTES = 32 << 20
#: Quantile ranges of a forest's large nodes.
FOREST_BINS = 256
PURE = 1e-12
#: Quantile ranges that narrow exact splits, and the most of all nodes and
#: features: with more nodes the ranges of each grow wider.
RANGES, MOST_RANGES = 512, 400_000
#: Up to so many classes the worth inside a range is bounded.
BOUND_CLASSES = 6
#: Rows a task of a forest adds up, and packs, at a time, and the most sums of
#: large nodes it keeps: more nodes take several tasks over the same rows.
CHUNK_ROWS, PACK_ROWS, MOST_SUMS = 1 << 14, 1 << 16, 4_000_000
#: From so many rows on, a node in memory sorts only those that may hold its split.
NARROW_ROWS = 1 << 15
#: Bytes of packed rows per task that finishes small nodes, at most and at least.
FINISH_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: Small nodes are finished in turns of so many bytes of packed rows, or of so many
#: trees where those are more; the shuffle of a turn goes before the next.
TURN_BYTES, TURN_TREES = 1 << 30, 4

# Share of rows drawn at most 0, 1, 2 ... times by a bootstrap.
_DRAWN = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
# The same by the first 12 bits of the number; 255 where they do not tell.
_CELLS = np.searchsorted(_DRAWN, np.arange(4097) / 4096, side="right")
_DRAWN_BY_BITS = np.where(_CELLS[1:] == _CELLS[:-1], _CELLS[:-1], 255).astype(np.uint8)


@dataclass(frozen=True)
class Growth:
    """``classes`` is 0 for regression; ``features`` how many a node may look at."""

    classes: int
    width: int
    max_depth: int
    min_split: int = 2
    min_leaf: int = 1
    criterion: str = "gini"
    trees: int = 1
    features: int = 0
    bootstrap: bool = False
    bins: int = 0
    seed: int = 42
    local_bytes: int = LOCAL_BYTES

    @property
    def sums(self) -> int:
        return self.classes or 3

    def candidates(self, tree: int, node: int) -> np.ndarray:
        if not self.features or self.features >= self.width:
            return np.arange(self.width)
        draw = np.random.Generator(np.random.Philox(key=[self.seed + 1, tree], counter=[0, 0, 0, node]))
        return np.sort(draw.permutation(self.width)[: self.features])

    def weights(self, rows: np.ndarray, tree: int) -> np.ndarray:
        if not self.bootstrap:
            return np.ones(len(rows), np.int64)
        z = _mixed(rows, self.seed * 1_000_003 + tree)
        drawn = _DRAWN_BY_BITS.take((z >> np.uint64(52)).view(np.int64))
        unsure = np.flatnonzero(drawn == 255)
        drawn[unsure] = np.searchsorted(_DRAWN, _uniform(rows[unsure], self.seed * 1_000_003 + tree), side="right")
        return drawn

    def stats(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Per row what a node sums up: class weights, or weight, sum and squares."""
        if not self.classes:
            return np.column_stack(self.moments(y, w)).astype(float)
        out = np.zeros((len(y), self.classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out

    def moments(self, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        return [w, w * y, w * y * y]

    def size(self, s: np.ndarray) -> np.ndarray:
        return sum(s[..., c] for c in range(s.shape[-1])) if self.classes else s[..., 0]

    def worth(self, s: np.ndarray) -> np.ndarray:
        """Minus the weighted impurity, up to what splits do not change."""
        n = np.maximum(self.size(s), 1e-300)
        if not self.classes:
            return s[..., 1] ** 2 / n
        parts = [s[..., c] for c in range(s.shape[-1])]
        if self.criterion == "gini":
            return sum(p * p for p in parts) / n
        return sum(p * np.log2(np.maximum(p, 1e-300)) for p in parts) - n * np.log2(n)

    def impurity(self, s: np.ndarray) -> float:
        """Of one node, per row."""
        n = max(float(self.size(s)), 1e-300)
        if not self.classes:
            return max(0.0, float(s[2] / n - (s[1] / n) ** 2))
        p = s[s > 0] / n
        return float(1 - (p * p).sum() if self.criterion == "gini" else -(p * np.log2(p)).sum())

    def closed(self, node: int, s: np.ndarray) -> bool:
        deep = node.bit_length() > self.max_depth
        return deep or self.size(s) < max(self.min_split, 2 * self.min_leaf) or self.impurity(s) <= PURE


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 random bits from row numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64)
        z *= np.uint64(0x9E3779B97F4A7C15)
        z += np.uint64(seed % 2**63) * np.uint64(0xD1B54A32D192ED03)
        moved = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            z ^= np.right_shift(z, np.uint64(shift), out=moved)
            z *= np.uint64(factor)
    return z


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from row numbers."""
    return (_mixed(x, seed) >> np.uint64(11)) * 2.0**-53


@dataclass
class Tree:
    """Nodes by heap number (the root is 1): feature (-1: leaf), threshold, sums
    and gain."""

    feature: dict[int, int] = field(default_factory=dict)
    threshold: dict[int, float] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    gain: dict[int, float] = field(default_factory=dict)

    def paths(self) -> tuple[np.ndarray, ...]:
        """The nodes from the root down as lists: number, feature, threshold, and
        the places of the two children of each."""
        nodes, kids = [1], []
        for n in nodes:
            split = self.feature.get(n, -1) >= 0
            kids += [len(nodes), len(nodes) + 1] if split else [0, 0]
            nodes += [2 * n, 2 * n + 1] if split else []
        feature = np.array([self.feature.get(n, -1) for n in nodes])
        return np.array(nodes), feature, np.array([self.threshold.get(n, 0.0) for n in nodes]), np.array(kids)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node each row has come to: a leaf, or one not split yet."""
        nodes, *paths = self.paths()
        return nodes[descend(x.ravel(), np.arange(len(x)) * x.shape[1], *paths)]


def descend(x: np.ndarray, starts: np.ndarray, feature: np.ndarray, threshold: np.ndarray, kids: np.ndarray) -> np.ndarray:
    """The place of the node each row comes to; a row's values begin at ``starts``."""
    out, here, live = np.zeros(len(starts), np.intp), np.zeros(len(starts), np.intp), np.arange(len(starts))
    while len(live):
        f = feature.take(here)
        moves = f >= 0
        if not moves.all():
            out[live[~moves]] = here[~moves]
            live, here, starts, f = live[moves], here[moves], starts[moves], f[moves]
        here = kids.take(2 * here + ~(x.take(starts + f) <= threshold.take(here)))
    return out


def _between(low: float, high: float) -> float:
    middle = low / 2 + high / 2
    return float(middle if low <= middle < high else low)


@dataclass
class _Part:
    """The rows of a node in memory: per feature the places of their values among
    the distinct ones, and targets (class numbers, or y) with weights."""

    codes: list[np.ndarray]
    y: np.ndarray
    w: np.ndarray

    def take(self, rows: np.ndarray) -> _Part:
        return _Part([c.take(rows) for c in self.codes], self.y.take(rows), self.w.take(rows))

    def total(self, growth: Growth) -> np.ndarray:
        if growth.classes:
            return np.bincount(self.y, self.w, growth.classes)
        if len(self.y) < NARROW_ROWS:
            return growth.stats(self.y, self.w).sum(0)
        return np.array([m.sum() for m in growth.moments(self.y, self.w)])

    def by(self, growth: Growth, bins: np.ndarray, count: int) -> np.ndarray:
        """The sums of each bin."""
        if growth.classes:
            return np.bincount(bins * growth.classes + self.y, self.w, count * growth.classes).reshape(count, -1)
        own = np.zeros((count, growth.sums))
        # Splits are compared without squares.
        own[:, 0], own[:, 1] = np.bincount(bins, self.w, count), np.bincount(bins, self.w * self.y, count)
        return own

    def splits(self, growth: Growth, f: int, total: np.ndarray, rows: np.ndarray | None = None, before=None) -> tuple[float, int]:
        """The best worth over the splits behind each value of a feature, and the
        place of the value; with ``rows`` over those only, whose bins (ascending
        with the value) have the sums ``before`` them."""
        part, bins = (self, None) if rows is None else (self.take(rows), before[0].take(rows))
        key = (part.codes[f].astype(np.int64) << 32) | np.arange(len(part.y))
        key.sort()
        order, code = key & 0xFFFFFFFF, key >> 32
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], rows is not None))
        if not len(ends):
            return -np.inf, -1
        if growth.classes:
            label, w = part.y.take(order), part.w.take(order)
            columns = [np.where(label == c, w, 0.0) for c in range(growth.classes)]
        else:
            w = part.w.take(order)
            columns = [w, w * part.y.take(order)]
        sums = [c.cumsum(dtype=float) for c in columns]
        left = np.array([c.take(ends) for c in sums])
        if bins is not None:
            bins = bins.take(order)
            first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
            shift = np.array([before[1][bins[first], i] - np.where(first > 0, c[first - 1], 0.0) for i, c in enumerate(sums)])
            left = left + shift[:, np.searchsorted(first, ends, side="right") - 1]
        left = left.T
        right, least = total[: left.shape[1]] - left, max(1, growth.min_leaf)
        able = (growth.size(left) >= least) & (growth.size(right) >= least)
        worth = np.full(len(ends), -np.inf)
        worth[able] = growth.worth(left[able]) + growth.worth(right[able])
        at = int(np.argmax(worth))
        return float(worth[at]), int(code[ends[at]])

    def best(self, growth: Growth, features: list[int], total: np.ndarray) -> tuple[float, int, int]:
        """Worth, feature and place of the value of the best split.  Of many rows
        only those in bins whose bound reaches the best known split are sorted."""
        found = []
        if len(self.y) < NARROW_ROWS or growth.classes > BOUND_CLASSES:
            found = [(*self.splits(growth, f, total), f) for f in features]
        else:
            parts, known, least = [], -np.inf, max(1, growth.min_leaf)
            ends = float(self.y.min()), float(self.y.max())
            for f in features:
                first, last = int(self.codes[f].min()), int(self.codes[f].max())
                if first == last:
                    continue
                bins = ((self.codes[f] - first) >> max(0, (last - first).bit_length() - 8)).astype(np.intp)
                own = self.by(growth, bins, int(bins.max()) + 1)
                upto = own.cumsum(0)
                able = (growth.size(upto) >= least) & (growth.size(total - upto) >= least)
                if able.any():
                    known = max(known, float((_worths(growth, upto[able]) + _worths(growth, (total - upto)[able])).max()))
                low, high = (np.full(len(own), v) for v in ends)
                parts.append((f, bins, upto - own, bounds(growth, upto - own, own, low, high, total)))
            # Rounding must not cost a split.
            edge = known - 1e-9 * (1 + abs(known)) if known > -np.inf else -np.inf
            for f, bins, before, bound in parts:
                rows = np.flatnonzero((bound >= edge).take(bins))
                if len(rows):
                    found.append((*self.splits(growth, f, total, rows, (bins, before)), f))
        worth, place, f = max(found, key=lambda r: r[0], default=(-np.inf, -1, -1))
        return worth, f, place


def grow(
    growth: Growth, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, halved: float = np.inf
) -> Iterator[tuple]:
    """Nodes below ``root``, itself included: node, feature, threshold, gain, sums.
    Nodes of more than ``halved`` rows split at a value, not half-way to the next."""
    faces = [np.unique(x[:, f], return_inverse=True) for f in range(growth.width)]
    label = y.astype(np.intp) if growth.classes else y
    stack = [(root, _Part([code.astype(np.int32) for _, code in faces], label, w.astype(float)))]
    while stack:
        node, part = stack.pop()
        total = part.total(growth)
        worth, f, place = -np.inf, -1, -1
        if not growth.closed(node, total):
            worth, f, place = part.best(growth, growth.candidates(tree, node).tolist(), total)
        if worth == -np.inf:
            yield node, -1, 0.0, 0.0, total
            continue
        values, codes = faces[f][0], part.codes[f]
        left = codes <= place
        low, high = values[place], values[codes[~left].min()]
        threshold = float(low) if growth.size(total) > halved else _between(low, high)
        yield node, f, threshold, max(0.0, worth - float(growth.worth(total))), total
        stack += [(2 * node + 1, part.take(np.flatnonzero(~left))), (2 * node, part.take(np.flatnonzero(left)))]


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return batch.column(0).to_numpy(), np.where(np.isnan(x), np.inf, x), batch.column(2).to_numpy(zero_copy_only=False)


def _chunks(
    batches: Iterator[pa.RecordBatch], width: int, size: int = CHUNK_ROWS
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, inputs and targets of ``size`` rows or up to a batch more at a time."""
    held: list = []
    for batch in batches:
        held.append(_rows(batch, width))
        if sum(len(number) for number, _, _ in held) >= size:
            yield tuple(np.concatenate(part) for part in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def _level(rows: DataFrame, growth: Growth, trees: list[Tree], large: set, edges: list, chosen: dict) -> DataFrame:
    """``tree, node, feature, bin, value`` with the label sums of the large nodes
    inside their ``chosen`` ranges."""
    names = [f"s{i}" for i in range(growth.sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, x, y = _rows(batch, growth.width)
            for t, tree in enumerate(trees):
                w = growth.weights(number, t)
                at = tree.route(x)
                for node in np.unique(at).tolist():
                    if (t, node) not in large:
                        continue
                    held = np.flatnonzero((at == node) & (w > 0))
                    sums = growth.stats(y[held], w[held])
                    for f in growth.candidates(t, node).tolist():
                        v = x[held, f]
                        inside = np.isin(_bins(edges[f], v), chosen.get((t, node, f), []))
                        v, own = v[inside], sums[inside]
                        if not len(v):
                            continue
                        value, back = np.unique(v, return_inverse=True)
                        parts = [np.bincount(back, own[:, c], len(value)) for c in range(growth.sums)]
                        same = [pa.array(np.full(len(value), k)) for k in (t, node, f)]
                        bins = _bins(edges[f], value)
                        yield pa.RecordBatch.from_arrays(
                            [*same, pa.array(bins), pa.array(value), *[pa.array(p) for p in parts]], [*keys, *names]
                        )

    keys = ["tree", "node", "feature", "bin", "value"]
    schema = "tree long, node long, feature long, bin long, value double, " + ", ".join(f"{c} double" for c in names)
    return rows.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def _bins(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The range of each value; one more than there are edges."""
    return np.searchsorted(edges, v)


def _ranges(rows: DataFrame, growth: Growth, trees: list[Tree], large: dict, edges: list) -> list:
    """``tree, node, feature, bin``, the least value, the least and greatest label
    and the label sums of each filled range of the large nodes."""
    names = [f"s{i}" for i in range(growth.sums)]
    places = {key: i for i, key in enumerate(large)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(e) + 1 for e in edges]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        cells = len(places) * starts[-1]
        sums, least = np.zeros((growth.sums, cells)), np.full(cells, np.inf)
        low, high, met = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells, bool)
        for batch in batches:
            number, x, y = _rows(batch, growth.width)
            held = [_bins(edges[f], x[:, f]) for f in range(growth.width)]
            for t, tree in enumerate(trees):
                w, at = growth.weights(number, t), tree.route(x)
                for node in np.unique(at).tolist():
                    if (t, node) not in large:
                        continue
                    mine = np.flatnonzero((at == node) & (w > 0))
                    stats = growth.stats(y[mine], w[mine])
                    for f in growth.candidates(t, node).tolist():
                        first = places[(t, node)] * starts[-1] + starts[f]
                        part, cell = slice(first, first + sizes[f]), held[f][mine]
                        for c in range(growth.sums):
                            sums[c, part] += np.bincount(cell, stats[:, c], sizes[f])
                        np.minimum.at(least[part], cell, x[mine, f])
                        met[first + cell] = True
                        if not growth.classes:
                            np.minimum.at(low[part], cell, y[mine])
                            np.maximum.at(high[part], cell, y[mine])
        filled, keys = np.flatnonzero(met), list(places)
        if not len(filled):
            return
        place, rest = filled // starts[-1], filled % starts[-1]
        f = np.searchsorted(starts, rest, side="right") - 1
        pairs = np.array(keys, np.int64).reshape(-1, 2)[place]
        columns = [pairs[:, 0], pairs[:, 1], f, rest - starts[f], least[filled], low[filled], high[filled], *sums[:, filled]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*keys_of, "least", "low", "high", *names])

    keys_of = ["tree", "node", "feature", "bin"]
    schema = ", ".join(f"{k} long" for k in keys_of) + ", least double, low double, high double, " + ", ".join(f"{c} double" for c in names)
    merged = rows.mapInArrow(run, schema).groupBy(*keys_of)
    # MOST_RANGES rows at most.
    return merged.agg(F.min("least"), F.min("low"), F.max("high"), *[F.sum(c) for c in names]).collect()


def _worths(growth: Growth, s: np.ndarray) -> np.ndarray:
    """``Growth.worth``, 0 where there is nothing."""
    return np.where(growth.size(s) > 1e-9, growth.worth(np.where(growth.size(s)[..., None] > 1e-9, s, 1.0)), 0.0)


def bounds(growth: Growth, before: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Per range no less than the worth of any split inside it: the greatest at
    the corners of what a part of its rows can sum up to."""
    if growth.classes > BOUND_CLASSES:
        return np.full(len(own), np.inf)
    if growth.classes:
        corners = [own * c for c in np.ndindex(*(2,) * growth.classes)]
    else:
        n, s, gap = own[:, 0], own[:, 1], np.where(high > low, high - low, 1.0)
        upper = np.where(high > low, np.clip((s - n * low) / gap, 0, n), 0)
        lower = np.where(high > low, np.clip((n * high - s) / gap, 0, n), 0)
        parts = [(0 * n, 0 * n), (n, s), (upper, upper * high), (lower, lower * low)]
        corners = [np.column_stack([m, t, 0 * m]) for m, t in parts]
    return np.max([_worths(growth, before + c) + _worths(growth, total - before - c) for c in corners], axis=0)


def narrow(growth: Growth, found: list, large: dict) -> dict:
    """(tree, node, feature, bin) of the ranges that may hold a node's best split,
    with the sums before them and the least value behind them."""
    spots: dict = {}
    for r in found:
        spots.setdefault((r[0], r[1]), {}).setdefault(r[2], []).append(r)
    out = {}
    for key, features in spots.items():
        total, best, parts = large[key], -np.inf, []
        for f, rows in features.items():
            rows = sorted(rows, key=lambda r: r[3])
            own = np.array([r[7:] for r in rows], float)
            upto = np.cumsum(own, axis=0)
            after = total - upto
            least = max(1, growth.min_leaf)
            able = (growth.size(upto) >= least) & (growth.size(after) >= least)
            able[-1] = False
            worth = np.where(able, _worths(growth, upto) + _worths(growth, after), -np.inf)
            best = max(best, float(worth.max()))
            low, high = (np.array([r[i] for r in rows], float) for i in (5, 6))
            before = upto - own
            parts.append((f, rows, before, bounds(growth, before, own, low, high, total)))
        # Rounding must not cost a split.
        edge = best - 1e-9 * (1 + abs(best)) if best > -np.inf else -np.inf
        for f, rows, before, bound in parts:
            for i in np.flatnonzero(bound >= edge):
                behind = rows[i + 1][4] if i + 1 < len(rows) else None
                out[(*key, f, rows[i][3])] = (before[i], behind)
    return out


def _inside(rows: DataFrame, growth: Growth, trees: list[Tree], large: dict, ranges: list) -> list:
    """One row per large node: its best exact split with the left side's sums."""
    names = [f"s{i}" for i in range(growth.sums)]
    wide = max(1, -(-RANGES * len(large) * growth.width // MOST_RANGES))
    edges = [e[::-1][::wide][::-1] for e in ranges]
    kept = narrow(growth, _ranges(rows, growth, trees, large, edges), large)
    spark, keys = rows.sparkSession, ["tree", "node", "feature", "bin"]
    if not kept:
        return []
    kinds = ", ".join(f"{k} long" for k in keys) + ", behind double, " + ", ".join(f"b{i} double, t{i} double" for i in range(growth.sums))
    facts = [(*map(int, k), nxt, *[float(v) for pair in zip(b, large[k[:2]]) for v in pair]) for k, (b, nxt) in kept.items()]
    known = F.broadcast(spark.createDataFrame(facts, kinds))
    chosen: dict = {}
    for t, node, f, b in kept:
        chosen.setdefault((t, node, f), []).append(b)
    found = _level(rows, growth, trees, set(large), edges, {k: np.array(sorted(v)) for k, v in chosen.items()})
    # A range holds a bounded share of a feature's rows, so a window is no bottleneck.
    order = Window.partitionBy(*keys).orderBy("value")
    run = found.select(*keys, "value", F.lead("value").over(order).alias("lead"), *[F.sum(c).over(order).alias(f"r{c}") for c in names])
    both = run.join(known, keys)
    left = [F.col(f"rs{i}") + F.col(f"b{i}") for i in range(growth.sums)]
    right = [F.col(f"t{i}") - a for i, a in enumerate(left)]
    sizes = [sum(side[1:], side[0]) if growth.classes else side[0] for side in (left, right)]
    high = F.coalesce("lead", "behind")
    able = both.filter((sizes[0] >= max(1, growth.min_leaf)) & (sizes[1] >= max(1, growth.min_leaf)) & high.isNotNull())
    worth = (_worth(growth, left) + _worth(growth, right)).alias("worth")
    pick = F.struct(worth, (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"), F.array(*left).alias("left"), high.alias("high"))
    best = able.groupBy("tree", "node").agg(F.max(pick).alias("b"))
    return best.select("tree", "node", (-F.col("b.f")).alias("feature"), (-F.col("b.v")).alias("low"), "b.worth", "b.left", "b.high").collect()


def _worth(growth: Growth, parts: list[Column]) -> Column:
    """``Growth.worth`` as a column."""
    if not growth.classes:
        return parts[1] * parts[1] / parts[0]
    n = sum(parts[1:], parts[0])
    if growth.criterion == "gini":
        return sum([p * p for p in parts[1:]], parts[0] * parts[0]) / n
    logs = [F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)) for p in parts]
    return sum(logs[1:], logs[0]) - n * F.log2(n)


def _sums(rows: DataFrame, growth: Growth, trees: list[Tree], large: list, edges: list) -> DataFrame:
    """``tree, node, part`` with the label sums of the large nodes by quantile range
    (sums x candidates x ranges): a row per node from each task that meets it."""
    wide, width = max(1, *map(len, edges)), growth.width
    spots = {}
    for t in sorted({t for t, _ in large}):
        nodes, *paths = trees[t].paths()
        own = np.array([n for tree, n in large if tree == t])
        place = {n: i for i, n in enumerate(own.tolist())}
        looks = np.array([growth.candidates(t, n) for n in own.tolist()])
        spots[t] = own, np.array([place.get(n, -1) for n in nodes.tolist()]), paths, looks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((growth.sums, looks.shape[1], len(own) * wide)) for t, (own, _, _, looks) in spots.items()}
        for number, x, y in _chunks(batches, width):
            flat = x.ravel()
            # The last range takes what lies beyond.
            bins = np.column_stack([np.clip(_bins(edges[f], x[:, f]), 0, max(0, len(edges[f]) - 1)) for f in range(width)]).ravel()
            for t, (own, place, paths, looks) in spots.items():
                w = growth.weights(number, t)
                held = np.flatnonzero(w)
                node = place.take(descend(flat, held * width, *paths))
                if len(node) and node.min() < 0:
                    held, node = held[node >= 0], node[node >= 0]
                cells = len(own) * wide
                if growth.classes:
                    first, weights = y[held].astype(np.intp) * cells + node * wide, [w[held]]
                else:
                    first, weights = node * wide, growth.moments(y[held], w[held])
                for j in range(looks.shape[1]):
                    cell = first + bins.take(held * width + looks[:, j].take(node))
                    found = [np.bincount(cell, v, cells * (growth.classes or 1)) for v in weights]
                    sums[t][:, j] += np.reshape(found, (growth.sums, cells))
        part = TaskContext.get().partitionId()
        for t, (own, _, _, looks) in spots.items():
            by_node = sums.pop(t).reshape(growth.sums, looks.shape[1], len(own), wide).transpose(2, 0, 1, 3)
            met = np.flatnonzero(by_node.any(axis=(1, 2, 3)))
            blobs = pa.array([by_node[i].tobytes() for i in met], pa.binary())
            same = [pa.array(np.full(len(met), k)) for k in (t, part)]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(own[met]), same[1], blobs], ["tree", "node", "part", "sums"])

    return rows.mapInArrow(run, "tree long, node long, part long, sums binary")


def _binned(rows: DataFrame, growth: Growth, trees: list[Tree], large: dict, edges: list) -> list:
    """One row per large node: its best split at the end of a quantile range with
    the left side's sums."""
    wide, keys = max(1, *map(len, edges)), sorted(large)
    width = growth.features if 0 < growth.features < growth.width else growth.width
    most = max(1, MOST_SUMS // (growth.sums * width * wide))
    parts = [_sums(rows, growth, trees, keys[i : i + most], edges) for i in range(0, len(keys), most)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    least = max(1, growth.min_leaf)

    def best(key: tuple, table: pa.Table) -> pa.Table:
        t, node = key[0].as_py(), key[1].as_py()
        total, pick = large[(t, node)], None
        blobs = table.sort_by("part").column("sums").to_pylist()
        sums = sum(np.frombuffer(b) for b in blobs).reshape(growth.sums, width, wide)
        for j, f in enumerate(growth.candidates(t, node).tolist()):
            left = sums[:, j].cumsum(1).T[:-1]
            right = total - left
            # A side of nothing is no split.
            able = (growth.size(left) >= least) & (growth.size(right) >= least)
            worth = np.where(able, _worths(growth, left) + _worths(growth, right), -np.inf)
            at = int(np.argmax(worth)) if len(worth) else -1
            if at >= 0 and worth[at] > -np.inf and (pick is None or worth[at] > pick[1]):
                pick = (f, float(worth[at]), float(edges[f][at]), left[at].tolist())
        made = [(t, node, *pick)] if pick else []
        names = ["tree", "node", "feature", "worth", "low", "left"]
        return pa.table({c: pa.array([m[i] for m in made], k) for i, (c, k) in enumerate(zip(names, kinds))})

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
    # One row per large node.
    return found.groupBy("tree", "node").applyInArrow(
        best, "tree long, node long, feature long, worth double, low double, left array<double>"
    ).collect()


def fit_trees(rows: DataFrame, growth: Growth, edges: list | None = None) -> list[Tree]:
    """``rows``: row (number), x, y; written.  ``edges``: ascending upper ends of the
    quantile ranges per feature, used where ``growth.bins`` is set."""
    trees = [Tree() for _ in range(growth.trees)]
    fits = max(1, growth.local_bytes // (8 * (growth.width + 2 + growth.sums)))
    names = [f"s{i}" for i in range(growth.sums)]
    # Without ranges a forest's table is small enough to be finished as it is.
    whole = bool(growth.bins) and not edges

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((growth.trees, growth.sums))
        for number, _, y in _chunks(batches, growth.width):
            for t in range(growth.trees):
                w = growth.weights(number, t)
                sums[t] += np.bincount(y.astype(np.intp), w, growth.classes) if growth.classes else [m.sum() for m in growth.moments(y, w)]
        columns = [pa.array(np.arange(growth.trees)), *[pa.array(sums[:, c]) for c in range(growth.sums)]]
        yield pa.RecordBatch.from_arrays(columns, ["tree", *names])

    counted = rows.mapInArrow(roots, "tree long, " + ", ".join(f"{c} double" for c in names))
    open_ = {}
    for r in counted.groupBy("tree").agg(*[F.sum(c).alias(c) for c in names]).collect():  # one row per tree
        open_[(r["tree"], 1)] = np.array([r[c] for c in names])
    small: dict = {}
    ranges = None
    while open_:
        large = {}
        for (t, node), total in open_.items():
            if growth.closed(node, total):
                trees[t].feature[node], trees[t].sums[node], trees[t].gain[node] = -1, total, 0.0
            elif whole or growth.size(total) <= fits:
                small[(t, node)] = total
            else:
                large[(t, node)] = total
        open_ = {}
        if not large:
            break
        if growth.bins:
            splits = _binned(rows, growth, trees, large, edges)
        else:
            ranges = quantile_edges(rows, growth.width, RANGES) if ranges is None else ranges
            splits = _inside(rows, growth, trees, large, ranges)
        for (t, node), total in large.items():
            trees[t].feature[node], trees[t].sums[node], trees[t].gain[node] = -1, total, 0.0
        for r in splits:
            t, node, total, left = r["tree"], r["node"], large[(r["tree"], r["node"])], np.array(r["left"])
            # Ranges are split at their upper end, values half-way to the next.
            threshold = r["low"] if growth.bins else _between(r["low"], r["high"])
            trees[t].feature[node], trees[t].threshold[node] = r["feature"], threshold
            trees[t].gain[node] = max(0.0, r["worth"] - float(growth.worth(total)))
            open_[(t, 2 * node)], open_[(t, 2 * node + 1)] = left, total - left
        if growth.bins:
            drop_shuffles(rows.sparkSession)
    if small:
        _finish(rows, growth, trees, small, fits if whole else np.inf)
    return trees


def _packed_rows(rows: DataFrame, growth: Growth, trees: list[Tree], small: set) -> DataFrame:
    """``tree, node, row`` and ``x0 ..., y, w``: the drawn rows of the small nodes, a
    record per chunk and node that holds the values of each column one after
    another.  ``row`` is the number of the first."""
    spots = {}
    for t in sorted({t for t, _ in small}):
        nodes, *paths = trees[t].paths()
        spots[t] = nodes, np.array([(t, n) in small for n in nodes.tolist()]), paths
    names = [*[f"x{f}" for f in range(growth.width)], "y", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x, y in _chunks(batches, growth.width, PACK_ROWS):
            order = np.argsort(number, kind="stable")
            number, x, y = number[order], x[order], y[order].astype(_label_type(growth))
            flat, columns = x.ravel(), [*np.ascontiguousarray(x.T), y]
            for t, (nodes, mine, paths) in spots.items():
                w = growth.weights(number, t).astype(np.uint8)
                held = np.flatnonzero(w)
                at = descend(flat, held * growth.width, *paths)
                if not mine.all():
                    own = np.flatnonzero(mine.take(at))
                    held, at = held[own], at[own]
                if not len(held):
                    continue
                # Places of up to 16 bits are sorted without comparisons.
                by = np.argsort(at.astype(np.uint16) if len(nodes) < 1 << 16 else at, kind="stable")
                held, at = held[by], at[by]
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                ends = np.append(starts, len(held))
                keys = [np.full(len(starts), t), nodes[at[starts]], number[held[starts]]]
                packs = [_cut(c.take(held), ends) for c in (*columns, w)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *packs], ["tree", "node", "row", *names])

    return rows.mapInArrow(run, "tree long, node long, row long, " + ", ".join(f"{c} binary" for c in names))


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, each the memory of the values from one end to the next."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _label_type(growth: Growth) -> type:
    return np.uint8 if 0 < growth.classes <= 256 else np.float64


def _turns(growth: Growth, small: dict) -> list[list]:
    """The small nodes by tree, cut where their packed rows would be more than a turn's."""
    sizes = {key: float(growth.size(total)) * (8 * growth.width + 9) for key, total in sorted(small.items())}
    by_tree: dict = {}
    for (t, _), size in sizes.items():
        by_tree[t] = by_tree.get(t, 0.0) + size
    most, turns, held = max(TURN_BYTES, TURN_TREES * max(by_tree.values())), [[]], 0.0
    for key, size in sizes.items():
        if turns[-1] and held + size > most:
            turns.append([])
            held = 0.0
        turns[-1].append(key)
        held += size
    return turns


def _finish(rows: DataFrame, growth: Growth, trees: list[Tree], small: dict, halved: float) -> None:
    """Grow the subtrees of the small nodes, each in one task."""

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        t, node = key[0].as_py(), key[1].as_py()
        table = table.sort_by("row")
        types = [*[np.float64] * growth.width, _label_type(growth), np.uint8]
        *x, y, w = (np.frombuffer(b"".join(c.to_pylist()), k) for c, k in zip(table.columns[3:], types))
        made = list(grow(growth, t, node, np.array(x).T, y, w, halved))
        nodes, feature, threshold, gain, sums = zip(*made)
        arrays = [[t] * len(made), nodes, feature, threshold, gain, [s.tolist() for s in sums]]
        return pa.table(dict(zip(["tree", "node", "feature", "threshold", "gain", "sums"], arrays)))

    def turn(keys: list) -> list[dict]:
        size = sum(float(growth.size(small[k])) for k in keys) * (8 * growth.width + 9)
        tasks = max(size // FINISH_BYTES, min(4 * cores, size // LEAST_BYTES)) + 1
        dealt = _packed_rows(rows, growth, trees, set(keys)).repartition(int(min(len(keys), tasks)), "tree", "node")
        done = dealt.groupBy("tree", "node").applyInArrow(
            finish, "tree long, node long, feature long, threshold double, gain double, sums array<double>"
        )
        # The model itself: as many rows as the trees have nodes.
        return done.toArrow().to_pylist()

    cores = rows.sparkSession.sparkContext.defaultParallelism
    for i, keys in enumerate(_turns(growth, small)):
        if i:
            drop_shuffles(rows.sparkSession)
        for r in turn(keys):
            tree, node = trees[r["tree"]], r["node"]
            tree.feature[node], tree.gain[node], tree.sums[node] = r["feature"], r["gain"], np.array(r["sums"])
            if r["feature"] >= 0:
                tree.threshold[node] = r["threshold"]


def quantile_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper ends of about equally filled ranges, the largest value last."""
    shares = [(i + 1) / bins for i in range(bins)]
    cells = rows.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"c{i}") for i in range(width)])
    found = cells.approxQuantile([f"c{i}" for i in range(width)], shares, 0.1 / bins)
    return [np.unique(np.array(q, float)) for q in found]


def packed(trees: list[Tree], growth: Growth) -> list[dict]:
    """Trees as plain lists in node order, children by place in the list."""
    out = []
    for tree in trees:
        nodes = sorted(tree.feature)
        place = {n: i for i, n in enumerate(nodes)}
        inner = [tree.feature[n] >= 0 for n in nodes]
        values = [tree.sums[n] / max(float(growth.size(tree.sums[n])), 1e-300) if n in tree.sums else None for n in nodes]
        out.append(
            {
                "node": nodes,
                "feature": [int(tree.feature[n]) for n in nodes],
                "threshold": [float(tree.threshold.get(n, 0.0)) for n in nodes],
                "left": [place[2 * n] if i else -1 for n, i in zip(nodes, inner)],
                "right": [place[2 * n + 1] if i else -1 for n, i in zip(nodes, inner)],
                "value": [(v if growth.classes else v[1:2]).tolist() for v in values],
                "n": [float(growth.size(tree.sums[n])) for n in nodes],
                "gain": [float(tree.gain[n]) for n in nodes],
            }
        )
    return out


def importances(trees: list[dict], width: int) -> np.ndarray:
    """Mean share of each tree's gain by feature."""
    total = np.zeros(width)
    for tree in trees:
        own = np.zeros(width)
        for f, g in zip(tree["feature"], tree["gain"]):
            if f >= 0:
                own[f] += g
        total += own / own.sum() if own.sum() > 0 else 0.0
    return total / total.sum() if total.sum() > 0 else total


def average(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean leaf values of the trees: class shares, or one number."""
    x = np.where(np.isnan(x), np.inf, x)
    flat, starts = x.ravel(), np.arange(len(x)) * x.shape[1]
    out = 0.0
    for tree in trees:
        kids = np.column_stack([tree["left"], tree["right"]]).ravel()
        at = descend(flat, starts, np.array(tree["feature"]), np.array(tree["threshold"]), kids)
        out = out + np.array(tree["value"], float)[at]
    return out / len(trees)
