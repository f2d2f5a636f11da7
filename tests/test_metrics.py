"""Metrics against brute force on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import classification as C
from rowmill.operators import clustering as K
from rowmill.operators import learn as L
from rowmill.operators import regression as R
from rowmill.plans import training as T


def brute_silhouette(x, y):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    out = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][y == c].mean() for c in set(y) if c != y[i])
        out.append((b - a) / max(a, b))
    return out


def points(spark, n=90, k=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    y[0] = 99  # a cluster of one
    x = rng.normal(size=(n, 3)) + y[:, None]
    df = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))], "i int, c int, v array<double>")
    return K.as_points(df, "i", "c", "v"), x, y


@pytest.mark.parametrize("block", [2048, 7])
def test_silhouette_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    df, x, y = points(spark)
    got = {r["id"]: r["silhouette"] for r in K.silhouette_points(df).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(brute_silhouette(x, y))


def test_rows_of_the_pairwise_grid_are_shuffled_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 2)
    df, x, y = points(spark, n=120)
    pairs = K._grid(df, df, 120, lambda a, b: a[:1][["id"]], "id int", K.MOST_TILES).count()
    # 60 tiles a side, but no more than twice BLOCKS blocks.
    assert K.BLOCKS <= pairs**0.5 <= 2 * K.BLOCKS
    got = {r["id"]: r["silhouette"] for r in K.silhouette_points(df).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(brute_silhouette(x, y))


@pytest.mark.parametrize("block", [2048, 2])
def test_davies_bouldin_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    df, x, y = points(spark)
    names = sorted(set(y))
    m = {c: x[y == c].mean(0) for c in names}
    s = {c: np.linalg.norm(x[y == c] - m[c], axis=1).mean() for c in names}
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(m[i] - m[j]) for j in names if j != i) for i in names])
    assert K.davies_bouldin(df).first()[0] == pytest.approx(want)


def test_one_cluster_has_silhouette_zero(spark):
    df = spark.createDataFrame([(i, 1, [float(i)]) for i in range(5)], "i int, c int, v array<double>")
    assert K.silhouette(K.as_points(df, "i", "c", "v")).first()[0] == 0.0


def test_auc_is_the_rank_probability(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.uniform(size=300) + 0.3 * y, 1)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "y boolean, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert C.roc_auc(df, F.col("y"), F.col("s")).first()["roc_auc"] == pytest.approx(want)


def test_one_class_gives_no_auc(spark):
    df = spark.createDataFrame([(True, 0.5), (True, 0.7)], "y boolean, s double")
    assert C.roc_auc(df, F.col("y"), F.col("s")).first()["roc_auc"] is None


def test_perfect_and_useless_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a")], "y string, p string")
    row = C.class_metrics(df, "y", "p").first()
    assert row["accuracy"] == row["cohen_kappa"] == row["matthews_corrcoef"] == 1.0
    flat = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    row = C.class_metrics(flat, "y", "p").first()
    assert row["matthews_corrcoef"] == 0.0 and row["balanced_accuracy"] == 0.5


def test_confusion_fills_unseen_pairs(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "b")], "y string, p string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in C.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9 and cells[("a", "c")] == 1 and cells[("c", "a")] == 0


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=200) + 5, rng.normal(size=200) + 5
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    row = R.regression_metrics(df, "y", "p").first()
    assert row["r2_score"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row["median_ae"] == pytest.approx(np.median(np.abs(y - p)))
    assert row["mape"] == pytest.approx(np.mean(np.abs((y - p) / y)) * 100)
    stats = R.residual_stats(df, "y", "p").first()
    assert stats["q25"] == pytest.approx(np.percentile(y - p, 25))
    assert not math.isnan(stats["std"])


def test_null_is_a_class_of_the_confusion_matrix(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None), ("a", "b")], "y string, p string")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in C.confusion_matrix(df, "y", "p").collect()}
    assert len(cells) == 9 and cells["b", None] == 1 and cells[None, None] == 0 and sum(cells.values()) == 3


def test_estimated_silhouette_has_its_error(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 2)) + 2.5 * np.stack([y, y == 1], axis=1)
    df = spark.createDataFrame([(i, int(c), [float(v) for v in a]) for i, (c, a) in enumerate(zip(y, x))], "i int, c int, v array<double>")
    points = K.as_points(df, "i", "c", "v")
    exact = float(np.mean(brute_silhouette(x, y)))
    whole = K.silhouette_sampled(points).first()
    assert (whole["silhouette"], whole["silhouette_error"], whole["n_clusters"]) == (pytest.approx(exact), 0.0, 3)
    offs = []
    for seed in range(6):
        part = K.silhouette_sampled(points, rows=150, seed=seed).first()
        offs.append((part["silhouette"] - exact) / part["silhouette_error"])
    assert np.abs(offs).max() < 4 and np.abs(offs).min() > 0
    assert K.silhouette_sampled(points.filter("cluster = 0")).first()["silhouette"] == 0.0


def test_clusterings_are_evaluated_without_a_key(spark):
    df = spark.createDataFrame([(float(i % 2) * 5 + i / 100,) for i in range(40)], "a double")
    model = L.fit(df, "kmeans", ["a"], parameters={"n_clusters": 2})
    found = {r["metric"]: r["value"] for r in T.evaluate(model, df).collect()}
    pairs = {r["metric"]: r["value"] for r in T.evaluate(model, df, exact=True).collect()}
    assert found["silhouette_score"] == pytest.approx(pairs["silhouette_score"])
    assert found["silhouette_score"] > 0.9 and found["n_clusters"] == 2
