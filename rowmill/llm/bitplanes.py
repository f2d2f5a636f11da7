"""Centroid clustering on bit planes.

A vector of 64 integers is kept as its two's complement bit planes: plane b packs
bit b of all 64 components into one uint64.  The dot product of two vectors is
the sum over plane pairs of their weights times popcount(plane AND plane), which
is exact, and squared distances follow from dot products.  The sums of a cluster
are counts of set bits per plane and component, so they are exact at any size.

Vectors are packed once and written.  Each round is one scan of the planes:
tasks keep counts per centroid, and one row per centroid reaches the driver.

Defined results: vectors of another length, or with a NULL or non-finite
component, are left out; a NULL id seeds no centroid before all other ids;
repeated rows are separate vectors, and equal ids with different vectors rank by
the bytes of their planes; fewer vectors than centroids give fewer centroids; distances
and inertias beyond 64 bits are NULL, the clusters still exact; an empty table
gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1"

#: Up to this many planes every sum fits 64 bits; beyond, Python integers are used.
NARROW = 28
#: Plane words handled at a time within a task.
BATCH = 1 << 16


def usable(vector: Column, width: int = WIDTH) -> Column:
    """Whether an array has ``width`` components, none missing or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def _weights(planes: int) -> np.ndarray:
    """Place values; the last plane holds the sign."""
    values = [1 << b for b in range(planes - 1)] + [-(1 << (planes - 1))]
    return np.array(values, dtype=np.int64 if planes <= NARROW else object)


def _integer(x: float, scale: int) -> int:
    scaled = x * scale
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * scale


def _integers(x: np.ndarray, scale: int, planes: int) -> np.ndarray:
    if planes <= 62:
        return np.floor(x * scale).astype(np.int64)
    return np.array([_integer(float(v), scale) for v in x.ravel()], dtype=object).reshape(x.shape)


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Integers ``(n, 64)`` as planes ``(n, planes)`` of uint64."""
    out = np.empty((len(values), planes), np.uint64)
    for b in range(planes):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def unpack(planes: np.ndarray) -> np.ndarray:
    """Bits ``(n, planes * 64)`` in component order within each plane."""
    return np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little")


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of packed vectors ``(n, planes)`` and ``(k, planes)``."""
    planes = left.shape[1]
    weights = _weights(planes)
    out = np.zeros((len(left), len(right)), weights.dtype)
    for b in range(planes):
        both = np.bitwise_count(left[:, b, None, None] & right[None, :, :])
        out += (both.astype(np.int64) @ weights) * weights[b]
    return out


def norms(packed: np.ndarray) -> np.ndarray:
    """Dot product of each packed vector with itself."""
    planes = packed.shape[1]
    weights = _weights(planes)
    out = np.zeros(len(packed), weights.dtype)
    for b in range(planes):
        both = np.bitwise_count(packed[:, b, None] & packed)
        out += (both.astype(np.int64) @ weights) * weights[b]
    return out


def nearest(packed: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smallest number on ties, and the squared distance."""
    far = own[:, None] + norms(centroids)[None, :] - 2 * dots(packed, centroids)
    # For Python integers argmin takes the first least one, too.
    best = np.argmin(far, axis=1).astype(np.int64)
    return best, far[np.arange(len(far)), best]


def _planes_needed(df: DataFrame, vector: str, scale: int) -> int:
    """Planes of the widest component, the sign's included."""
    ends = df.agg(
        F.min(F.array_min(vector)).cast("double").alias("least"), F.max(F.array_max(vector)).cast("double").alias("most")
    ).first()
    if ends["least"] is None:
        return 1
    least, most = (_integer(ends[c], scale) for c in ("least", "most"))
    return 1 + max((~least if least < 0 else least).bit_length(), (~most if most < 0 else most).bit_length())


def _packer(scale: int, planes: int, width: int):
    step = max(1, BATCH // planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                packed = pack(_integers(flat.reshape(-1, width), scale, planes), planes)
                cells = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(8 * planes), len(packed), [None, pa.py_buffer(packed.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), cells.cast(pa.binary())], ["id", "planes"])

    return run


def _planes_of(batch: pa.RecordBatch, column: int, planes: int) -> np.ndarray:
    data = b"".join(batch.column(column).to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, planes)


def packed_vectors(df: DataFrame, key: str, vector: str, scale: int, width: int) -> tuple[DataFrame, int]:
    """``(id, planes)`` of the usable rows, written, and the number of planes."""
    x = F.col(vector).cast("array<double>")
    kept = df.select(F.col(key).alias("id"), x.alias("x")).filter(usable(F.col("x"), width))
    planes = _planes_needed(kept, "x", scale)
    kind = kept.schema["id"].dataType.simpleString()
    return settle(kept.mapInArrow(_packer(scale, planes, width), f"id {kind}, planes binary")), planes


def _counter(centroids: np.ndarray, planes: int):
    k, step = len(centroids), max(1, BATCH // planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bits = np.zeros(k, np.int64), np.zeros((k, planes * WIDTH), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                packed = _planes_of(whole.slice(at, step), 0, planes)
                best, _ = nearest(packed, norms(packed), centroids)
                member = np.zeros((k, len(packed)), np.float32)
                member[best, np.arange(len(packed))] = 1
                # Counts below 2**24 are exact in single precision.
                bits += (member @ unpack(packed).astype(np.float32)).astype(np.int64)
                rows += np.bincount(best, minlength=k)
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(rows[held]), pa.array([bits[c] for c in held], pa.list_(pa.int64()))],
            ["cluster", "n", "bits"],
        )

    return run


def _assigner(centroids: np.ndarray, planes: int):
    step = max(1, BATCH // planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                packed = _planes_of(batch, 1, planes)
                best, far = nearest(packed, norms(packed), centroids)
                far = [int(d) if d < 2**63 else None for d in far] if far.dtype == object else far
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"]
                )

    return run


@dataclass
class Clustering:
    """``centroids``: integer components in centroid order.  ``assigned``:
    ``(id, cluster, distance)`` of every vector, written."""

    centroids: list[list[int]]
    assigned: DataFrame


def _moved(parts: DataFrame, centroids: list[list[int]], planes: int) -> list[list[int]]:
    """Floor means of the clusters' bit counts; empty clusters stay."""
    places = F.posexplode("bits").alias("place", "bit")
    # One row per centroid, whatever the input's size.
    sums = (
        parts.select("cluster", "n", places)
        .groupBy("cluster", "place")
        .agg(F.sum("n").alias("n"), F.sum("bit").alias("bit"))
        .groupBy("cluster")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "bit")))["bit"].alias("bits"))
        .collect()
    )
    weights, out = [int(w) for w in _weights(planes)], list(centroids)
    for row in sums:
        table = np.array(row["bits"], dtype=object).reshape(planes, WIDTH)
        out[row["cluster"]] = [sum(w * int(c) for w, c in zip(weights, table[:, i])) // row["n"] for i in range(WIDTH)]
    return out


def _packed_centroids(centroids: list[list[int]], planes: int) -> np.ndarray:
    return pack(np.array(centroids, dtype=object if planes > 62 else np.int64).reshape(-1, WIDTH), planes)


def cluster(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: str = SEED,
) -> Clustering:
    """Lloyd rounds from the ``k`` vectors whose ids hash lowest with ``seed``."""
    vectors, planes = packed_vectors(df, key, vector, scale, WIDTH)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    weights = [int(w) for w in _weights(planes)]
    # At most k rows besides equal ids' ties, which their planes decide.
    first = vectors.orderBy(order.asc_nulls_last(), "planes").limit(k).collect()
    bits = [unpack(np.frombuffer(bytes(r["planes"]), np.uint64)[None, :]).reshape(planes, WIDTH) for r in first]
    centroids = [[sum(w * int(b[p, i]) for p, w in enumerate(weights)) for i in range(WIDTH)] for b in bits]
    if centroids:
        for _ in range(rounds):
            counter = _counter(_packed_centroids(centroids, planes), planes)
            parts = vectors.select("planes").mapInArrow(counter, "cluster int, n long, bits array<long>")
            centroids = _moved(parts, centroids, planes)
    kind = vectors.schema["id"].dataType.simpleString()
    assigner = _assigner(_packed_centroids(centroids, planes), planes)
    return Clustering(centroids, settle(vectors.mapInArrow(assigner, f"id {kind}, cluster int, distance long")))


def digest(found: Clustering, key: str = "vec_id") -> DataFrame:
    """Per vector its cluster, distance, the inertias and the centroid's sha256."""
    spark = found.assigned.sparkSession
    # Beyond 64 bits an inertia is NULL, as are the distances it would sum.
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    # One row per centroid at most.
    sums = {r["cluster"]: r["s"] for r in found.assigned.groupBy("cluster").agg(whole.alias("s")).collect()}
    total = None if None in sums.values() else int(sum(sums.values()))
    fits = lambda v: None if v is None or v >= 2**63 else int(v)
    texts = [",".join(map(str, c)) for c in found.centroids]
    rows = [(i, fits(sums.get(i)), fits(total), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]
    small = spark.createDataFrame(rows, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.assigned.join(F.broadcast(small), F.col("cluster") == F.col("_c"))
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
