"""Exact interpolated quantiles without gathering a column anywhere.

``percentile`` keeps every distinct value of a column in one buffer, which
cannot work for a column of 10^12 different doubles.  Here each quantile is
closed in by brackets instead:

1. a KLL sketch per column (merged in two levels) proposes a bracket;
2. one pass counts the rows at, below and strictly inside each bracket, so
   the bracket is *proved* to hold the wanted ranks or is moved;
3. brackets with too many rows inside are narrowed with a sketch of their
   inside, and step 2 repeats;
4. the few distinct values left inside are grouped and the two neighbouring
   order statistics are read off.

The sketch only steers; the counts decide.  So results are exact for every
input, including columns where one value holds most rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmill.functions.columns import number

SKETCH_SIZE = 1600
GRID = 512
MERGE_GROUPS = 256
GATHER_ROWS = 200_000


@dataclass(eq=False)
class _Target:
    """One wanted quantile and the bracket ``[lo, hi]`` closing in on it."""

    column: str
    prob: float
    rank: int  # 0-based rank of the lower neighbour
    last: int  # 0-based rank of the upper neighbour
    frac: float
    floor: float  # proved bounds: both neighbours lie in [floor, ceiling]
    ceiling: float
    lo: float = 0.0
    hi: float = 0.0
    under_lo: int = 0  # rows < lo
    upto_lo: int = 0  # rows <= lo
    under_hi: int = 0  # rows < hi
    upto_hi: int = 0  # rows <= hi

    @property
    def inside(self) -> int:
        return max(0, self.under_hi - self.upto_lo)

    def at_end(self, rank: int) -> float | None:
        """The order statistic when it is a bracket end (bracket proved)."""
        if rank < self.upto_lo:
            return self.lo
        if rank >= self.under_hi:
            return self.hi
        return None

    def open(self) -> bool:
        return self.at_end(self.rank) is None or self.at_end(self.last) is None

    def propose(self, grid: list[float], share: float) -> None:
        """Take the sketch points around ``share`` as the next bracket."""
        self.lo, self.hi = self.floor, self.ceiling
        if grid:
            i, j = math.floor(share * GRID) - 2, math.ceil(share * GRID) + 2
            if i > 0:
                self.lo = max(self.floor, grid[i])
            if j < GRID:
                self.hi = min(self.ceiling, grid[j])

    def prove(self) -> bool:
        """Accept the bracket, or move it towards the wanted ranks."""
        if self.rank < self.under_lo:
            self.lo, self.hi = self.floor, self.lo
            return False
        if self.last >= self.upto_hi:
            self.lo, self.hi = (self.hi if self.rank >= self.under_hi else self.lo), self.ceiling
            return False
        self.floor, self.ceiling = self.lo, self.hi
        return True


def _sketch(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple]:
    """``(count, min, max, grid)`` of each expression, in one scan.

    Sketches are merged per group of map tasks first; otherwise the one final
    task would have to merge a sketch from every task of the scan.
    """
    names = list(exprs)
    size = F.lit(SKETCH_SIZE)
    parts: list[Column] = []
    whole: list[Column] = []
    out: list[Column] = []
    ranks = F.expr("array({})".format(", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))))
    for i, k in enumerate(names):
        x = exprs[k]
        parts += [
            F.kll_sketch_agg_double(x, size).alias(f"s{i}"),
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"a{i}"),
            F.max(x).alias(f"b{i}"),
        ]
        whole += [
            F.kll_merge_agg_double(f"s{i}", size).alias(f"s{i}"),
            F.sum(f"n{i}").alias(f"n{i}"),
            F.min(f"a{i}").alias(f"a{i}"),
            F.max(f"b{i}").alias(f"b{i}"),
        ]
        grid = F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", ranks))
        out.append(F.struct(f"n{i}", f"a{i}", f"b{i}", grid.alias("g")).alias(f"t{i}"))
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_g")
    row = df.groupBy(group).agg(*parts).agg(*whole).select(*out).first()
    return {k: (row[i][0] or 0, row[i][1], row[i][2], row[i][3] or []) for i, k in enumerate(names)}


def _segment_counter(cuts: dict[str, np.ndarray]):
    """Per task: rows in each segment that a column's cut points make.

    Segment ``2k`` lies before cut ``k`` and segment ``2k + 1`` is the cut
    itself.  One binary search per value replaces dozens of conditional sums,
    whose generated code is too big for the JIT compiler.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {c: np.zeros(2 * len(v) + 1, dtype=np.int64) for c, v in cuts.items()}
        for batch in batches:
            for c, v in cuts.items():
                x = batch[c].to_numpy(dtype=np.float64)
                x = x[~np.isnan(x)]
                at = np.searchsorted(v, x, "left") + np.searchsorted(v, x, "right")
                totals[c] += np.bincount(at, minlength=2 * len(v) + 1)
        yield pd.DataFrame(
            [(c, k, n) for c, t in totals.items() for k, n in enumerate(t.tolist()) if n],
            columns=["c", "k", "n"],
        )

    return count


def _count(df: DataFrame, exprs: dict[str, Column], targets: list[_Target]) -> None:
    keys = sorted({t.column for t in targets})
    cuts = {
        str(i): np.unique([v for t in targets if t.column == k for v in (t.lo, t.hi)])
        for i, k in enumerate(keys)
    }
    narrow = df.select(*[exprs[k].alias(str(i)) for i, k in enumerate(keys)])
    counts = narrow.mapInPandas(_segment_counter(cuts), "c string, k int, n long")
    cumulative = {c: np.zeros(2 * len(v) + 1, dtype=np.int64) for c, v in cuts.items()}
    # A handful of rows per cut point.
    for row in counts.groupBy("c", "k").agg(F.sum("n").alias("n")).collect():
        cumulative[row["c"]][row["k"]] = row["n"]
    for t in targets:
        c = str(keys.index(t.column))
        total = np.cumsum(cumulative[c])
        lo, hi = (2 * int(np.searchsorted(cuts[c], v)) for v in (t.lo, t.hi))
        t.under_lo, t.upto_lo = int(total[lo]), int(total[lo + 1])
        t.under_hi, t.upto_hi = int(total[hi]), int(total[hi + 1])


def _within(x: Column, t: _Target) -> Column:
    return (x > t.lo) & (x < t.hi)


def _inside_picker(brackets: list[tuple[str, float, float]]):
    """The values strictly inside each bracket."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = {c: batch[c].to_numpy(dtype=np.float64) for c in batch.columns}
            hits = [arrays[c][(arrays[c] > lo) & (arrays[c] < hi)] for c, lo, hi in brackets]
            yield pd.DataFrame(
                {"t": np.repeat(np.arange(len(hits)), [len(h) for h in hits]), "v": np.concatenate(hits)}
            )

    return pick


def _gather(
    df: DataFrame, exprs: dict[str, Column], targets: list[_Target]
) -> dict[int, dict[int, float]]:
    """Order statistics strictly inside the (now small) brackets."""
    keys = sorted({t.column for t in targets})
    narrow = df.select(*[exprs[k].alias(str(i)) for i, k in enumerate(keys)])
    brackets = [(str(keys.index(t.column)), t.lo, t.hi) for t in targets]
    values = narrow.mapInPandas(_inside_picker(brackets), "t int, v double")
    counts = values.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn(
        "upto", F.sum("n").over(Window.partitionBy("t").orderBy("v"))
    )
    wanted = F.lit(False)
    for i, t in enumerate(targets):
        for rank in {t.rank, t.last}:
            k = rank - t.upto_lo
            wanted = wanted | ((F.col("t") == i) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k))
    out: dict[int, dict[int, float]] = {}
    # At most two rows per target pass the filter.
    for row in running.filter(wanted).collect():
        t = targets[row["t"]]
        for rank in (t.rank, t.last):
            k = rank - t.upto_lo
            if row["upto"] - row["n"] <= k < row["upto"]:
                out.setdefault(row["t"], {})[rank] = row["v"]
    return out


def quantiles(
    df: DataFrame, wanted: dict[str, list[float]], exprs: dict[str, Column] | None = None
) -> dict[str, dict[float, float | None]]:
    """Exact linearly interpolated quantiles: ``{column: {prob: value}}``.

    ``wanted`` maps a column (or a key of ``exprs``) to probabilities.  Missing
    values are ignored; a column without values gives ``None``.
    """
    exprs = {c: exprs[c] if exprs and c in exprs else number(df, c) for c in wanted}
    result: dict[str, dict[float, float | None]] = {c: {} for c in wanted}
    if not exprs:
        return result
    sketches = _sketch(df, exprs)
    targets = []
    for c, probs in wanted.items():
        n, low, high, grid = sketches[c]
        for p in probs:
            if not n:
                result[c][p] = None
                continue
            at = (n - 1) * p
            rank = math.floor(at)
            t = _Target(c, p, rank, min(n - 1, rank + 1), at - rank, low, high)
            t.propose(grid, p)
            targets.append(t)

    pending = targets
    while pending:
        _count(df, exprs, pending)
        moved = [t for t in pending if not t.prove()]
        proved = [t for t in pending if t not in moved]
        wide = [t for t in proved if t.open() and t.inside > GATHER_ROWS]
        if wide:
            inner = {
                str(i): F.when(_within(exprs[t.column], t), exprs[t.column])
                for i, t in enumerate(wide)
            }
            for i, (_, _, _, grid) in enumerate(_sketch(df, inner).values()):
                t = wide[i]
                t.propose(grid, (t.rank - t.upto_lo) / max(1, t.inside - 1))
        pending = moved + wide

    unsolved = [t for t in targets if t.open()]
    found = _gather(df, exprs, unsolved) if unsolved else {}
    for t in targets:
        low, high = (
            t.at_end(r) if t.at_end(r) is not None else found[unsolved.index(t)][r]
            for r in (t.rank, t.last)
        )
        # Infinite neighbours must not give inf - inf.
        if t.frac == 0 or low == high:
            value = low
        elif math.isinf(low) or math.isinf(high):
            value = low * (1 - t.frac) + high * t.frac
        else:
            value = low + (high - low) * t.frac
        result[t.column][t.prob] = value
    return result
