"""Clustering metrics over an id, a cluster label and a feature vector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import col
from rowmill.functions.lookup import attach
from rowmill.functions.stats import ratio
from rowmill.functions.storage import settle
from rowmill.operators.shards import summed

# Points per tile of the pairwise grid: a tile pair is a 2048 x 2048 matrix.
BLOCK_ROWS = 2048
#: A block is as many tiles as leave this many blocks, up to the second number.
#: Every row is shuffled once per block, and a task holds two blocks of rows.
BLOCKS, MOST_TILES = 16, 32
#: Points measured against all others by the estimated silhouette.
SAMPLE_ROWS = 2000


def as_points(df: DataFrame, key: str, cluster: str, features: str | list[str]) -> DataFrame:
    """Normalise to ``(id, cluster, x array<double>)``.

    ``features`` is one array or vector column, or a list of numeric columns.
    """
    if isinstance(features, list):
        x = F.array(*[col(c).cast("double") for c in features])
    elif isinstance(df.schema[features].dataType, T.ArrayType):
        x = col(features).cast("array<double>")
    else:
        x = vector_to_array(col(features))
    return df.select(col(key).alias("id"), col(cluster).alias("cluster"), x.alias("x"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_profile(points: DataFrame) -> DataFrame:
    """``(cluster, size, centroid, variance)``; population variance per feature.

    One grouped vector aggregate: tasks hand over one row per cluster.
    """
    stats = points.groupBy("cluster").agg(
        Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("x")).alias("s")
    )
    n = F.col("s.count")
    return stats.select(
        "cluster",
        n.alias("size"),
        vector_to_array("s.mean").alias("centroid"),
        F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n).alias("variance"),
    )


def cluster_analysis(points: DataFrame) -> DataFrame:
    """``(cluster, feature, size, centroid, std)`` in long form."""
    return cluster_profile(points).select(
        "cluster",
        "size",
        F.posexplode(F.arrays_zip("centroid", "variance")).alias("feature", "z"),
    ).select("cluster", "feature", "size", F.col("z.centroid").alias("centroid"), F.sqrt("z.variance").alias("std"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between over within dispersion, from the cluster profile alone."""
    profile = settle(cluster_profile(points))
    per_feature = profile.select(
        "size", F.posexplode(F.arrays_zip("centroid", "variance")).alias("f", "z")
    ).select("f", "size", F.col("z.centroid").alias("m"), F.col("z.variance").alias("v"))
    grand = per_feature.groupBy("f").agg((F.sum(F.col("size") * F.col("m")) / F.sum("size")).alias("g"))
    gap = F.col("m") - F.col("g")
    sums = per_feature.join(grand, "f").agg(
        F.sum(F.col("size") * gap * gap).alias("b"), F.sum(F.col("size") * F.col("v")).alias("w")
    )
    facts = profile.agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum("size").alias("n"))).scalar()
    k, n = facts["k"], facts["n"]
    return sums.select(
        F.when((k > 1) & (n > k), ratio(F.col("b") * (n - k), F.col("w") * (k - 1), 1.0)).alias("calinski_harabasz")
    )


def _distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns, batch by batch."""

    @F.pandas_udf("double")
    def norm(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(np.stack(x) - np.stack(y), axis=1))

    return norm(a, b)


def _grid(left: DataFrame, right: DataFrame, rows: int, fn, schema: str, most: int = 1) -> DataFrame:
    """Run ``fn(left block, right block)`` for every pair of hash blocks.

    Blocks hold about ``BLOCK_ROWS`` rows of each side, and beyond ``BLOCKS`` of
    them up to ``most`` times as many, whatever the labels; only what ``fn``
    reduces them to leaves the task: no pair is ever a row.
    """
    tiles = max(1, math.ceil(rows / BLOCK_ROWS))
    blocks = math.ceil(tiles / max(1, min(most, tiles // BLOCKS)))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = F.expr(f"explode(sequence(0L, {blocks - 1}L))")
    a = left.select("*", mine.alias("_i")).select("*", every.alias("_j"))
    b = right.select("*", mine.alias("_j")).select("*", every.alias("_i"))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(fn, schema)


def _pairwise(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    return _distances(np.stack(a["x"]), np.stack(b["x"]))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    # Nearby points cancel in the expansion above: measure those directly.
    i, j = np.nonzero(sq < 1e-6 * (1.0 + (x * x).sum(1)[:, None]))
    if len(i):
        sq[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(sq, 0.0))


def _distance_sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per left point and right cluster: the sum of distances."""
    empty = pd.DataFrame({"id": a["id"][:0], "cluster": a["cluster"][:0], "other": b["cluster"][:0], "total": []})
    if a.empty or b.empty:
        return empty
    names, at = np.unique(b["cluster"].to_numpy(), return_inverse=True)
    x, y, sums = np.stack(a["x"]), np.stack(b["x"]), np.zeros((len(a), len(names)))
    for j in range(0, len(b), BLOCK_ROWS):
        member = np.zeros((len(y[j : j + BLOCK_ROWS]), len(names)))
        member[np.arange(len(member)), at[j : j + BLOCK_ROWS]] = 1.0
        for i in range(0, len(a), BLOCK_ROWS):
            sums[i : i + BLOCK_ROWS] += _distances(x[i : i + BLOCK_ROWS], y[j : j + BLOCK_ROWS]) @ member
    return pd.DataFrame(
        {
            "id": np.repeat(a["id"].to_numpy(), len(names)),
            "cluster": np.repeat(a["cluster"].to_numpy(), len(names)),
            "other": np.tile(names, len(a)),
            "total": sums.ravel(),
        }
    )


def silhouette_points(points: DataFrame) -> DataFrame:
    """``(id, cluster, silhouette)`` with exact Euclidean distances.

    Work is quadratic in the rows by definition of the score; memory per task
    is not.  For tables where that is too much use ``silhouette_squared``.
    """
    held = settle(points)
    n = held.count()
    types = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = f"id {types['id']}, cluster {types['cluster']}, other {types['cluster']}, total double"
    sums = (
        _grid(held, held, n, _distance_sums, schema, MOST_TILES)
        .groupBy("id", "cluster", "other")
        .agg(F.sum("total").alias("total"))
    )
    sizes = settle(
        held.groupBy(F.col("cluster").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n"))
    )
    joined = attach(sums, sizes, "other", ["size"])
    own = F.col("other") == F.col("cluster")
    scores = joined.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("size"))).alias("mine"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return scores.select(
        "id", "cluster", F.when(F.col("mine") > 1, ratio(b - a, F.greatest(a, b), 0.0)).otherwise(0.0).alias("silhouette")
    )


def silhouette(points: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette; 0 when there is a single cluster."""
    return silhouette_points(points).agg(F.coalesce(F.avg("silhouette"), F.lit(0.0)).alias("silhouette"))


def silhouette_sampled(points: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """``(silhouette, silhouette_error, n_clusters)`` in one pass over the points.

    The mean Euclidean silhouette of ``rows`` points drawn by a hash, each
    measured against every point: an unbiased estimate with its standard error,
    and the exact value, error 0, where there are no more points than that.  The
    driver and each task hold a number per drawn point and cluster.
    """
    kept = points.filter(F.col("cluster").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "cluster", "x")
    held = settle(kept)
    spark = held.sparkSession
    # One row per cluster.
    sizes = {r["cluster"]: r["n"] for r in held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    drawn = held.orderBy(F.xxhash64(F.lit(seed), "row"), "row").limit(rows).collect()
    place = {c: i for i, c in enumerate(names)}
    x, own = np.array([r["x"] for r in drawn], float), np.array([place[r["cluster"]] for r in drawn], int)
    number = np.array([r["row"] for r in drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(drawn), len(names)))
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                y = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                member = np.zeros((len(y), len(names)))
                member[np.arange(len(y)), [place[c] for c in batch.column(1).to_pylist()]] = 1.0
                gap = _distances(x, y)
                # A point is at 0 from itself, whatever the rounding.
                gap[number[:, None] == batch.column(0).to_numpy()[None, :]] = 0.0
                total += gap @ member
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], ["v"])

    score, error = 0.0, 0.0
    if len(names) > 1:
        flat = summed(held.mapInArrow(run, "v array<double>"), "v", len(drawn) * len(names)).reshape(len(drawn), -1)
        size, mine = np.array([sizes[c] for c in names], float), np.arange(len(drawn))
        a = flat[mine, own] / np.maximum(size[own] - 1, 1)
        other = flat / size
        other[mine, own] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        s = np.where((size[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        score, n = float(s.mean()), float(size.sum())
        if len(s) < n:
            error = float(s.std(ddof=1) / np.sqrt(len(s)) * np.sqrt(1 - len(s) / n))
    kinds = "silhouette double, silhouette_error double, n_clusters long"
    return spark.createDataFrame([(score, error, len(names))], kinds)


def silhouette_squared(points: DataFrame) -> float:
    """Mean silhouette on squared distances: linear in the rows, and a
    different number from ``silhouette``."""
    vectors = points.select(F.col("cluster").cast("double").alias("prediction"), array_to_vector("x").alias("features"))
    return ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(vectors)


def _worst_ratio(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per left centroid: the worst (s_i + s_j) / d_ij in the right block."""
    if a.empty or b.empty:
        return pd.DataFrame({"id": a["id"][:0], "worst": []})
    d = _pairwise(a, b)
    r = np.add.outer(a["s"].to_numpy(), b["s"].to_numpy())
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(d > 0, r / d, 0.0)
    r[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = 0.0
    return pd.DataFrame({"id": a["id"], "worst": r.max(axis=1)})


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst scatter-to-separation ratio."""
    profile = settle(
        cluster_profile(points).select(F.col("cluster").alias("key"), F.col("size").alias("n"), "centroid")
    )
    width = F.size("centroid")
    size = profile.agg(F.sum(width).alias("cells"), F.count(F.lit(1)).alias("k")).first()
    # attach() measures the key; the centroids are measured here.
    limit = 64 * 1024 * 1024 - 8 * (size["cells"] or 0)
    near = attach(points, profile, "cluster", ["centroid"], broadcast_bytes=limit)
    scatter = near.groupBy("cluster").agg(F.avg(_distance(F.col("x"), F.col("centroid"))).alias("s"))
    nodes = settle(
        profile.join(scatter, profile["key"].eqNullSafe(scatter["cluster"])).select(
            F.col("key").alias("id"), F.col("centroid").alias("x"), "s"
        )
    )
    kind = nodes.schema["id"].dataType.simpleString()
    worst = _grid(nodes, nodes, size["k"], _worst_ratio, f"id {kind}, worst double")
    return worst.groupBy("id").agg(F.max("worst").alias("w")).agg(F.avg("w").alias("davies_bouldin"))


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="error").transform(df)
