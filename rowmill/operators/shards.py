"""Training rows dealt to shards, for solvers that work on local data.

A shard is a bounded number of rows that one task holds at a time.  Rows are
dealt in turn, so equal or sorted rows spread, and the shards are written once:
a lost executor costs a re-read of the same shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

#: Rows of a shard, and the most shards; beyond, shards grow.
SHARD_ROWS = 20_000
MOST_SHARDS = 20_000
#: With ``few``, shards above this number grow instead, up to so many rows.
FEW_SHARDS, WIDE_SHARD_ROWS = 48, 1_000_000
#: Bytes of a record of packed rows.
PACK_BYTES = 4 << 20
#: Partial sums of shard vectors are summed in this many tasks, then in one.
BUCKETS = 64


@dataclass
class Shards:
    """``rows``: shard, at (place in the shard), x, y; kept until ``release``.
    ``mean`` and ``std`` are those of x's components, ``target`` those of y.
    With ``lanes`` the rows are packed (``unpack``): a partition per lane, that
    holds its share of the shards in order."""

    rows: DataFrame
    count: int
    n: int
    mean: np.ndarray
    std: np.ndarray
    target: tuple[float, float]
    lanes: int = 0

    def release(self) -> None:
        self.rows.unpersist()


def deal(vectors: DataFrame, features: str, target: Column, shard_rows: int = SHARD_ROWS, few: bool = False) -> Shards:
    """Shards of the rows of ``vectors`` without a missing feature or target."""
    x = vector_to_array(features)
    typed = vectors.select(x.alias("x"), target.cast("double").alias("y"))
    whole = settle(typed.filter(~F.exists("x", lambda v: F.isnan(v)) & F.col("y").isNotNull() & ~F.isnan("y")))
    v = array_to_vector("x")
    parts = Summarizer.metrics("mean", "std", "count").summary(v).alias("s")
    stats = whole.agg(parts, F.avg("y").alias("centre"), F.stddev_pop("y").alias("width")).select("s.*", "centre", "width").first()
    n, mean, std = int(stats["count"]), stats["mean"].toArray(), stats["std"].toArray()
    std[std == 0] = 1.0
    count = -(-n // shard_rows)
    if few:
        count = min(count, max(FEW_SHARDS, -(-n // max(shard_rows, WIDE_SHARD_ROWS))))
    count = max(1, min(MOST_SHARDS, count))
    target_facts = (stats["centre"] or 0.0, stats["width"] or 1.0)
    if few and count >= FEW_SHARDS:
        # A lane per core: the more steps it takes in an epoch, the fewer epochs are needed.
        lanes = min(count, whole.sparkSession.sparkContext.defaultParallelism)
        packed = settle(_packed(whole.repartition(count).select("x", "y"), mean, std))
        lane = F.pmod("shard", F.lit(lanes)).cast("int")
        rows = packed.repartitionById(lanes, lane).sortWithinPartitions("shard", "at").persist(StorageLevel.MEMORY_AND_DISK)
        return Shards(rows, count, n, mean, std, target_facts, lanes)
    dealt = whole.repartition(count).select(
        F.spark_partition_id().cast("long").alias("shard"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"),
        "x",
        "y",
    )
    # Long shards that share a partition would keep a task waiting for another.
    rows = (settle(dealt).repartition(2 * count, "shard") if few else settle(dealt).repartition("shard")).persist(StorageLevel.MEMORY_AND_DISK)
    return Shards(rows, count, n, mean, std, target_facts)


def _packed(dealt: DataFrame, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """``shard, at, x, y``: the standardised rows of a partition in single
    precision, a record per ``PACK_BYTES`` of inputs; ``at`` is that of the first."""
    size = max(1, PACK_BYTES // (4 * max(1, len(mean))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held, count = TaskContext.get().partitionId(), 0, [], 0

        def record(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            values = [pa.array([v], k) for v, k in zip((shard, at, x.tobytes(), y.tobytes()), kinds)]
            return pa.RecordBatch.from_arrays(values, ["shard", "at", "x", "y"])

        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held.append((((x - mean) / std).astype(np.float32), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32)))
            count += batch.num_rows
            if count >= size:
                x, y = (np.concatenate(part) for part in zip(*held))
                while len(y) >= size:
                    yield record(x[:size], y[:size])
                    x, y, at = x[size:], y[size:], at + size
                held, count = [(x, y)], len(y)
        if count:
            yield record(*(np.concatenate(part) for part in zip(*held)))

    return dealt.mapInArrow(run, "shard long, at long, x binary, y binary")


def unpack(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shard, place, x and y of each record of packed rows."""
    for shard, at, x, y in zip(*(c.to_pylist() for c in batch.columns)):
        yield shard, at, np.frombuffer(x, np.float32).reshape(-1, width), np.frombuffer(y, np.float32)


def local(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's x and y in the order of ``at``."""
    order = np.argsort(table.column("at").to_numpy())
    flat = table.column("x").combine_chunks()
    flat = flat.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(order), -1)[order], table.column("y").to_numpy()[order]


def summed(parts: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of an array column of ``size``; vectors are added on the executors."""
    bucket = F.pmod(F.spark_partition_id(), F.lit(BUCKETS)).alias("_b")
    near = parts.groupBy(bucket).agg(Summarizer.sum(array_to_vector(column)).alias("v"))
    # Grouped, since the summarizer refuses to sum no rows at all.
    total = near.groupBy(F.lit(0).alias("_all")).agg(Summarizer.sum(F.col("v")).alias("v")).first()
    return total["v"].toArray() if total else np.zeros(size)


def moments(shards: Shards, lift: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation (1 where there is none) of lifted rows, whose
    values are of about 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * size)
        for batch in batches:
            if batch.num_rows:
                z = lift(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                out += np.concatenate([z.sum(0), (z * z).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([out])], ["v"])

    flat = summed(shards.rows.select("x").mapInArrow(run, "v array<double>"), "v", 2 * size)
    mean = flat[:size] / max(1, shards.n)
    spread = np.maximum(flat[size:] - shards.n * mean * mean, 0.0) / max(1, shards.n - 1)
    std = np.sqrt(np.where(spread > 1e-14, spread, 1.0))
    return mean, std
