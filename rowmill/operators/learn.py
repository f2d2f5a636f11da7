"""The thirteen algorithms, fitted with Spark ML or the solvers beside this file."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.columns import col, family, number
from rowmill.functions.storage import settle
from rowmill.operators.components import principal
from rowmill.operators.gradient import (
    Standardised,
    fourier,
    fourier_map,
    initial_network,
    network_output,
    network_shapes,
    squared_loss,
    train,
)
from rowmill.operators.kmeans import distances, fit_kmeans, numbered
from rowmill.operators.networks import Net, fit_network, probabilities
from rowmill.operators.shards import SHARD_ROWS, deal, moments
from rowmill.operators.steps import align_features
from rowmill.operators.support import fit_svc, fit_svr
from rowmill.operators.trees import FOREST_BINS, LOCAL_BYTES, Growth, average, fit_trees, importances, packed, quantile_edges

SEED = 42

# Algorithm names, kinds, defaults and tunable parameters.
ALGORITHMS: dict[str, tuple[str, dict, list[str]]] = {
    "linear_regression": ("regression", {}, ["fit_intercept", "normalize"]),
    "decision_tree_regressor": (
        "regression",
        {"random_state": 42, "max_depth": 10},
        ["max_depth", "min_samples_split", "min_samples_leaf"],
    ),
    "random_forest_regressor": (
        "regression",
        {"n_estimators": 100, "random_state": 42, "max_depth": 10},
        ["n_estimators", "max_depth", "min_samples_split"],
    ),
    "svm_regressor": ("regression", {"kernel": "rbf", "C": 1.0}, ["kernel", "C", "gamma", "epsilon"]),
    "neural_network_regressor": (
        "regression",
        {"hidden_layer_sizes": (100,), "max_iter": 1000, "random_state": 42},
        ["hidden_layer_sizes", "learning_rate", "alpha"],
    ),
    "logistic_regression": (
        "classification",
        {"max_iter": 1000, "random_state": 42},
        ["C", "penalty", "solver"],
    ),
    "decision_tree_classifier": (
        "classification",
        {"random_state": 42, "max_depth": 10},
        ["max_depth", "min_samples_split", "criterion"],
    ),
    "random_forest_classifier": (
        "classification",
        {"n_estimators": 100, "random_state": 42, "max_depth": 10},
        ["n_estimators", "max_depth", "min_samples_split"],
    ),
    "svm_classifier": (
        "classification",
        {"kernel": "rbf", "random_state": 42},
        ["kernel", "C", "gamma"],
    ),
    "neural_network_classifier": (
        "classification",
        {"hidden_layer_sizes": (100,), "max_iter": 1000, "random_state": 42},
        ["hidden_layer_sizes", "learning_rate", "alpha"],
    ),
    "kmeans": (
        "clustering",
        {"n_clusters": 3, "random_state": 42, "n_init": 10},
        ["n_clusters", "init", "max_iter"],
    ),
    "hierarchical_clustering": (
        "clustering",
        {"n_clusters": 3, "linkage": "ward"},
        ["n_clusters", "linkage", "affinity"],
    ),
    "pca": ("dimensionality_reduction", {"n_components": 2}, ["n_components", "whiten"]),
}
# Further parameters of our own solvers.
OWN_PARAMETERS: dict[str, list[str]] = {
    "decision_tree_regressor": ["local_bytes"],
    "decision_tree_classifier": ["min_samples_leaf", "local_bytes"],
    "random_forest_regressor": ["min_samples_leaf", "max_bins", "local_bytes"],
    "random_forest_classifier": ["min_samples_leaf", "max_bins", "local_bytes", "criterion"],
    "svm_regressor": ["tol", "max_iter"],
    "svm_classifier": ["max_iter"],
    "neural_network_classifier": ["dropout", "batch_size", "tol"],
    "neural_network_regressor": ["tol"],
    "kmeans": ["tol"],
    "pca": ["svd_solver"],
}
AT_LEAST_ONE = ("max_depth", "n_estimators", "n_clusters", "n_components")
POSITIVE, POSITIVE_FLOOR = ("C", "gamma", "alpha", "learning_rate"), 1e-4
ITERATIONS_FLOOR = 100
# Hidden layers of the dense network and their dropout.
DENSE_NETWORK = [128, 64, 32]
DENSE_DROPOUT = [0.3, 0.3, 0.0]

#: Defaults of ``fit``'s sizes: random Fourier features of an RBF kernel, and
#: weighted centres the hierarchical clustering merges exactly.
FOURIER_SIZE = 200
MICRO_CLUSTERS = 1000
#: Trees are no deeper.
DEEPEST = 30
#: Rows of a forest's task, where there are more tasks than twice the cores.
SPREAD_ROWS = 20_000
#: Above so many columns ``svd_solver="auto"`` forms no square matrix.
WIDE = 500


def kind_of(algorithm: str) -> str:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Algorithm {algorithm} not supported")
    return ALGORITHMS[algorithm][0]


def parameters_for(algorithm: str, given: dict | None = None) -> dict:
    """Defaults overlaid with the known given parameters, clamped; other names
    are dropped."""
    kind_of(algorithm)
    _, defaults, tunable = ALGORITHMS[algorithm]
    out = dict(defaults)
    for name, value in (given or {}).items():
        if name not in tunable and name not in defaults and name not in OWN_PARAMETERS.get(algorithm, []):
            continue
        if name in AT_LEAST_ONE:
            value = max(1, int(value))
        elif name in POSITIVE and not isinstance(value, str):
            value = max(POSITIVE_FLOOR, float(value))
        elif name == "max_iter":
            value = max(ITERATIONS_FLOOR, int(value))
        out[name] = value
    return out


def refuse_unsupported(algorithm: str, given: dict | None) -> None:
    """Known options with a value that is not offered are errors."""
    asked = given or {}

    def only(name: str, *allowed: Any) -> None:
        if name in asked and asked[name] not in allowed:
            raise ValueError(f"{algorithm}: {name}={asked[name]!r} is not offered, only {', '.join(map(repr, allowed))}")

    if algorithm in ("svm_regressor", "svm_classifier"):
        only("kernel", "rbf", "linear")
        if isinstance(asked.get("gamma"), str):
            only("gamma", "auto", "scale")
    if algorithm == "hierarchical_clustering":
        only("linkage", "ward", "top_down")
        only("affinity", "euclidean")
    if algorithm == "logistic_regression":
        only("penalty", "l1", "l2", "none", None)
        only("solver", "lbfgs")
    if algorithm == "neural_network_regressor" or isinstance(asked.get("learning_rate"), str):
        only("learning_rate", "constant")
    if algorithm == "linear_regression":
        only("normalize", False)
    if algorithm == "pca":
        only("svd_solver", "auto", "full", "randomized")
    if algorithm == "kmeans" and (not isinstance(asked.get("init"), (list, np.ndarray))):
        only("init", "k-means++", "random")
    if algorithm in ("decision_tree_classifier", "random_forest_classifier"):
        only("criterion", "gini", "entropy", "log_loss")
    if algorithm.startswith(("decision_tree", "random_forest")) and int(asked.get("max_depth") or 1) > DEEPEST:
        raise ValueError(f"{algorithm}: max_depth is at most {DEEPEST}")


def recommend_algorithms(df: DataFrame, problem: str) -> DataFrame:
    """``(position, algorithm)`` by problem type and row count."""
    # Fixed values: (upper row limit, algorithms) per problem, smallest first.
    table = {
        "classification": [
            (1000, ["logistic_regression", "decision_tree_classifier"]),
            (10000, ["random_forest_classifier", "svm_classifier"]),
            (None, ["random_forest_classifier", "neural_network_classifier"]),
        ],
        "regression": [
            (1000, ["linear_regression", "decision_tree_regressor"]),
            (10000, ["random_forest_regressor", "svm_regressor"]),
            (None, ["random_forest_regressor", "neural_network_regressor"]),
        ],
        "clustering": [(5000, ["kmeans", "hierarchical_clustering"]), (None, ["kmeans"])],
    }
    choice = F.array().cast("array<string>")
    for limit, names in reversed(table.get(problem, [])):
        listed = F.array(*[F.lit(n) for n in names])
        choice = listed if limit is None else F.when(F.col("n") < limit, listed).otherwise(choice)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(choice).alias("position", "algorithm"))


@dataclass
class Model:
    """A fitted algorithm: Spark stages, plus numpy weights where Spark ML has
    no class.  ``score`` adds ``prediction`` (and ``probability``)."""

    algorithm: str
    features: list[str]
    target: str | None
    parameters: dict
    stages: PipelineModel | None = None
    labels: list[str] | None = None
    extra: dict[str, Any] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return kind_of(self.algorithm)

    def score(self, df: DataFrame) -> DataFrame:
        if "planes" in self.extra:
            return _vector(df, self.features).withColumn("prediction", self._side()).drop("features")
        if self.kind == "classification" and ("weights" in self.extra or "trees" in self.extra):
            return self._classes(df)
        if "trees" in self.extra:
            trees = self.extra["trees"]

            @F.pandas_udf("double")
            def leaf(rows: pd.Series) -> pd.Series:
                return pd.Series(average(trees, np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1))[:, 0])

            return _vector(df, self.features).withColumn("prediction", leaf(vector_to_array("features"))).drop("features")
        if "weights" in self.extra:
            return df.withColumn("prediction", self._gradient_prediction(df))
        if "loadings" in self.extra:
            return _vector(df, self.features).withColumn("components", self._projected()).drop("features")
        if "centres" in self.extra:
            return _vector(df, self.features).withColumn("prediction", self._nearest()).drop("features")
        out = self.stages.transform(_vector(df, self.features))
        if self.kind == "dimensionality_reduction":
            flip = np.array(self.extra["signs"])
            parts = vector_to_array("projected")
            signed = F.zip_with(parts, F.array(*[F.lit(float(s)) for s in flip]), lambda v, s: v * s)
            return out.withColumn("components", signed).drop("features", "centred", "projected")
        if self.labels is not None:
            names = F.array(*[F.lit(x) for x in self.labels])
            out = out.withColumn("prediction", names[F.col("prediction").cast("int")])
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("features", "rawPrediction", "_label")

    def _nearest(self):
        """The cluster of the nearest centre; none for a row with a missing component."""
        centres, names = np.array(self.extra["centres"]), np.array(self.extra.get("merge", range(len(self.extra["centres"]))))

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)
            return pd.Series(names[distances(x, centres).argmin(1)]).where(~np.isnan(x).any(1)).astype("Int32")

        return nearest(vector_to_array("features"))

    def _projected(self):
        """A row's components; NaN for a row with a missing value."""
        mean, loadings = np.array(self.extra["mean"]), np.array(self.extra["loadings"])

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), len(mean))
            return pd.Series(list((x - mean) @ loadings))

        # Arrow makes NULLs of NaN.
        return F.transform(project(vector_to_array("features")), lambda v: F.coalesce(v, F.lit(float("nan"))))

    def _gradient_prediction(self, df: DataFrame):
        w, mean, std = (np.array(self.extra[k]) for k in ("weights", "mean", "std"))
        shapes, kernel = self.extra.get("shapes"), self.extra.get("fourier")

        @F.pandas_udf("double")
        def predict(*cols: pd.Series) -> pd.Series:
            x = (np.column_stack([c.to_numpy(dtype=np.float64) for c in cols]) - mean[:-1]) / std[:-1]
            if kernel:
                z = fourier(x, *fourier_map(**kernel)) @ w[:-1] + w[-1]
            else:
                z = network_output(x, w, shapes)[-1][:, 0]
            return pd.Series(z * std[-1] + mean[-1])

        return predict(*[number(df, c) for c in self.features])

    def _side(self):
        """The class whose plane a row lies farthest above; none for a row with a
        missing feature."""
        planes, kernel, two = np.array(self.extra["planes"]), self.extra.get("fourier"), len(self.labels) == 2
        mean, std = (np.array(kernel[k]) for k in ("mean", "std")) if kernel else (0.0, 1.0)
        maps = fourier_map(**kernel["map"]) if kernel else None

        @F.pandas_udf("int")
        def place(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)
            z = (fourier((x - mean) / std, *maps) if maps else x) @ planes[:, :-1].T + planes[:, -1]
            best = (z[:, 0] > 0).astype(int) if two else z.argmax(1)
            return pd.Series(best).where(~np.isnan(x).any(1)).astype("Int32")

        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), place(vector_to_array("features")) + 1)

    def _classes(self, df: DataFrame) -> DataFrame:
        """Class shares of a network or of trees.  A network has no prediction
        for a row with a missing feature."""
        trees, shapes = self.extra.get("trees"), self.extra.get("shapes")
        w, mean, std = (np.array(self.extra.get(k, [])) for k in ("weights", "mean", "std"))

        @F.pandas_udf("array<double>")
        def predict(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)
            return pd.Series(list(average(trees, x) if trees else probabilities((x - mean) / std, w, shapes)))

        out = _vector(df, self.features).withColumn("probability", predict(vector_to_array("features"))).drop("features")
        names = F.array(*[F.lit(x) for x in self.labels])
        best = F.array_position("probability", F.array_max("probability"))
        first = F.col("probability")[0]
        known = first.isNotNull() & ~F.isnan(first)
        return out.withColumn("prediction", F.when(known, F.element_at(names, best.cast("int"))))

    def importances(self, spark: SparkSession) -> DataFrame:
        """``(feature, importance)`` of a tree model."""
        if "trees" not in self.extra:
            raise ValueError(f"{self.algorithm} has no feature importances")
        shares = importances(self.extra["trees"], len(self.features))
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, shares)], "feature string, importance double")

    def splits(self, spark: SparkSession) -> DataFrame:
        """``(tree, node, feature, threshold, n, gain)`` of the inner nodes of a
        tree model; the root is node 1, children of k are 2k and 2k + 1."""
        rows = [
            (t, node, self.features[f], cut, n, gain)
            for t, tree in enumerate(self.extra["trees"])
            for node, f, cut, n, gain in zip(*(tree[k] for k in ("node", "feature", "threshold", "n", "gain")))
            if f >= 0
        ]
        return spark.createDataFrame(rows, "tree int, node long, feature string, threshold double, n double, gain double")

    def save(self, spark: SparkSession, path: str, metadata: dict | None = None) -> str:
        card = {
            "algorithm": self.algorithm,
            "features": self.features,
            "target": self.target,
            "parameters": self.parameters,
            "labels": self.labels,
            "extra": self.extra,
            "metadata": metadata or {},
            "saved_timestamp": dt.datetime.now(dt.timezone.utc).isoformat(),
            "version": "1.0",
        }
        if self.stages is not None:
            self.stages.write().overwrite().save(f"{path}/stages")
        text = spark.createDataFrame([(json.dumps(card, default=_plain),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/card")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[Model, dict]:
        """The model and its metadata."""
        card = json.loads(spark.read.text(f"{path}/card").first()[0])
        stages = None if card["extra"].keys() & {"weights", "trees", "centres", "loadings", "planes"} else PipelineModel.load(f"{path}/stages")
        model = cls(
            card["algorithm"], card["features"], card["target"], card["parameters"], stages, card["labels"], card["extra"]
        )
        return model, card["metadata"]


def _plain(value: Any) -> Any:
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else str(value)


def _vector(df: DataFrame, features: list[str]) -> DataFrame:
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        return df.withColumn("features", array_to_vector(col(features[0]).cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def _logistic(p: dict, rows: int) -> C.LogisticRegression:
    reg = 0.0 if p.get("penalty", "l2") in (None, "none") else 1.0 / (p.get("C", 1.0) * rows)
    l1 = 1.0 if p.get("penalty") == "l1" else 0.0
    return C.LogisticRegression(
        maxIter=p["max_iter"], regParam=reg, elasticNetParam=l1, standardization=False, featuresCol="features", labelCol="_label"
    )


def _kernel(df: DataFrame, features: list[str], p: dict, size: int) -> dict:
    """RBF width: 1 / d on standardised features unless gamma is given."""
    scale = Standardised.of(df, features)
    gamma = p["gamma"] if isinstance(p.get("gamma"), float) else 1.0 / len(features)
    width = {"width": len(features), "size": size, "gamma": gamma, "seed": p.get("random_state", SEED)}
    return {"map": width, "mean": scale.mean.tolist(), "std": scale.std.tolist()}


def _ward(centres: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
    """Merge weighted centres down to k by Ward's cost, by chains of nearest
    neighbours: quadratic in the centres."""
    many = len(centres)
    n, c = sizes.astype(float).copy(), centres.astype(float).copy()
    live, merges, chain = np.ones(many, bool), [], []
    norm = (c * c).sum(1)

    def costs(i: int) -> np.ndarray:
        gap = np.maximum(norm + norm[i] - 2.0 * (c @ c[i]), 0.0)
        out = gap * n * n[i] / (n + n[i])
        out[~live] = np.inf
        out[i] = np.inf
        return out

    while live.sum() > 1 and many > k:
        if not chain:
            chain = [int(np.argmax(live))]
        cost = costs(chain[-1])
        j = int(np.argmin(cost))
        # The one before wins ties, or the chain would not end.
        if len(chain) > 1 and cost[chain[-2]] <= cost[j]:
            i, j = chain.pop(), chain.pop()
            i, j = min(i, j), max(i, j)
            merges.append((costs(i)[j], i, j))
            c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
            n[i], live[j] = n[i] + n[j], False
            norm[i] = c[i] @ c[i]
        else:
            chain.append(j)
    parent = list(range(many))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    # Ward's costs never fall along the hierarchy, so the cheapest merges come first.
    for _, i, j in sorted(merges, key=lambda m: m[0])[: many - k]:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    roots = [find(i) for i in range(many)]
    label = {root: g for g, root in enumerate(sorted(set(roots)))}
    return [label[root] for root in roots]


def _fit_clusters(algorithm: str, table: DataFrame, p: dict, micro: int) -> tuple[PipelineModel | None, dict]:
    """``approximate`` in the second part: the hierarchy was built over
    ``micro`` weighted centres, since there are more distinct points."""
    k = p["n_clusters"]
    if algorithm == "kmeans":
        init = p.get("init", "k-means++")
        found = fit_kmeans(
            numbered(table), k, p["n_init"], int(p.get("max_iter", 300)), float(p.get("tol", 1e-4)), p["random_state"], init
        )
        return None, {"centres": found.centres.tolist(), "inertia": found.inertia, "steps": found.steps, "inertias": found.inertias}
    if p.get("linkage") == "top_down":
        fitted = K.BisectingKMeans(k=k, seed=SEED).fit(table)
        return PipelineModel([fitted]), {}
    # Rows are points of their own while there are few enough of them.
    distinct = table.groupBy(vector_to_array("features").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    points = distinct.limit(max(k, micro) + 1).collect()
    exact = len(points) <= max(k, micro)
    if exact:
        points = sorted(points, key=lambda r: r["x"])
        centres, sizes = np.array([r["x"] for r in points]), np.array([r["n"] for r in points])
    else:
        found = K.KMeans(k=max(k, micro), seed=SEED, maxIter=p.get("max_iter", 300)).fit(table)
        centres = np.array(found.clusterCenters())
        # Fewer distinct points than micro-clusters give fewer centres.
        sizes = np.maximum(1, np.array(found.summary.clusterSizes))[: len(centres)]
    merge = _ward(centres, sizes, k) if len(centres) else []
    return None, {"centres": centres.tolist(), "merge": merge, "approximate": not exact}


def fit(
    df: DataFrame,
    algorithm: str,
    features: list[str],
    target: str | None = None,
    parameters: dict | None = None,
    max_jobs: int | None = None,
    fourier_size: int = FOURIER_SIZE,
    micro_clusters: int = MICRO_CLUSTERS,
    shard_rows: int = SHARD_ROWS,
) -> Model:
    """Fit one algorithm.

    ``max_jobs`` bounds the steps, epochs or rounds of our own solvers below the
    ``max_iter`` parameter; ``shard_rows`` is how many rows they hold in a task.
    ``fourier_size`` is the width of the RBF kernel's map,
    ``micro_clusters`` the number of centres the hierarchical clustering merges:
    with more distinct points it says ``approximate`` in ``extra``.  Values that
    cannot be honoured raise ValueError; parameters of other names are dropped.
    """
    refuse_unsupported(algorithm, parameters)
    p = parameters_for(algorithm, parameters)
    kind = kind_of(algorithm)
    model = Model(algorithm, features, target, p)
    if kind in ("regression", "classification") and not target:
        raise ValueError(f"{algorithm} needs a target")
    if algorithm == "svm_regressor":
        return _fit_support(df, model, p, max_jobs, fourier_size, shard_rows)
    if algorithm == "neural_network_regressor":
        return _fit_gradient(df, model, p, max_jobs)
    if kind == "regression":
        table = _vector(df, features).withColumn(target, number(df, target))
        if algorithm != "linear_regression":
            return _fit_trees(table, model, p, F.col(f"`{target}`"), 0)
        line = R.LinearRegression(
            regParam=0.0, solver="normal", fitIntercept=bool(p.get("fit_intercept", True)), featuresCol="features", labelCol=target
        )
        model.stages = PipelineModel([line.fit(table)])
    elif kind == "classification":
        if algorithm == "svm_classifier" and p["kernel"] == "rbf":
            model.extra["fourier"] = _kernel(df, features, p, fourier_size)
        table = _vector(df, features)
        text = table.withColumn("_text", col(target).cast("string"))
        index = StringIndexer(inputCol="_text", outputCol="_label", stringOrderType="alphabetAsc").fit(text)
        model.labels = list(index.labels)
        if algorithm in ("decision_tree_classifier", "random_forest_classifier"):
            return _fit_trees(index.transform(text), model, p, F.col("_label"), len(model.labels))
        if algorithm == "neural_network_classifier":
            return _fit_network(index.transform(text), model, p, max_jobs, shard_rows)
        if algorithm == "svm_classifier":
            return _fit_planes(index.transform(text), model, p, max_jobs, shard_rows)
        labelled = index.transform(text).drop("_text").persist()
        try:
            model.stages = PipelineModel([_logistic(p, labelled.count()).fit(labelled)])
        finally:
            labelled.unpersist()
    elif kind == "clustering":
        table = _vector(df, features).select("features").persist()
        try:
            model.stages, model.extra = _fit_clusters(algorithm, table, p, micro_clusters)
        finally:
            table.unpersist()
    else:
        table = _vector(df, features)
        solver = p.get("svd_solver", "auto")
        if solver == "randomized" or (solver == "auto" and _width(table, features) > WIDE):
            model.extra = _wide_components(table, p)
            return model
        centre = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
        project = PCA(k=p["n_components"], inputCol="centred", outputCol="projected")
        model.stages = Pipeline(stages=[centre, project]).fit(table)
        pc = model.stages.stages[-1].pc.toArray()
        signs = [1.0 if c[np.argmax(np.abs(c))] >= 0 else -1.0 for c in pc.T]
        if p.get("whiten"):
            parts = vector_to_array("projected")
            spread = model.stages.transform(table).agg(
                *[F.stddev_samp(parts[i]).alias(f"s{i}") for i in range(len(signs))]
            ).first()
            signs = [s / (d or 1.0) for s, d in zip(signs, spread)]
        model.extra = {"signs": signs, "explained": model.stages.stages[-1].explainedVariance.toArray().tolist()}
    return model


def _width(table: DataFrame, features: list[str]) -> int:
    """Components of the assembled vector."""
    if len(features) > 1:
        return len(features)
    row = table.select(F.size(vector_to_array("features"))).first()
    return row[0] if row else 0


def _wide_components(table: DataFrame, p: dict) -> dict:
    """Loadings signed like those of the narrow fit: the largest is positive."""
    found = principal(table, "features", int(p["n_components"]), int(p.get("random_state") or SEED))
    signs = np.array([1.0 if c[np.argmax(np.abs(c))] >= 0 else -1.0 for c in found.loadings.T])
    spread = np.sqrt(found.variances) if p.get("whiten") else np.ones(len(signs))
    return {
        "mean": found.mean.tolist(),
        "loadings": (found.loadings * signs / np.where(spread > 0, spread, 1.0)).tolist(),
        "explained": (found.variances / (found.total or 1.0)).tolist(),
        "residual": found.residual,
        "steps": found.steps,
    }


def _fit_gradient(df: DataFrame, model: Model, p: dict, max_jobs: int | None) -> Model:
    shapes = network_shapes(len(model.features), list(p["hidden_layer_sizes"]))
    loss, start = squared_loss(shapes), initial_network(shapes, p["random_state"])
    steps = min(p["max_iter"], max_jobs or 10**9)
    w, scale, trace = train(
        df, model.features, model.target, loss, start, p.get("alpha", 1e-4), steps, float(p.get("tol", 1e-4))
    )
    model.extra.update(
        {"weights": w.tolist(), "mean": scale.mean.tolist(), "std": scale.std.tolist(), "trace": [float(v) for v in trace]}
    )
    model.extra["shapes"] = shapes
    return model


def _fit_support(df: DataFrame, model: Model, p: dict, max_jobs: int | None, fourier_size: int, shard_rows: int) -> Model:
    """Support vector regression on standardised inputs and target."""
    width = len(model.features)
    shards = deal(_vector(df, model.features), "features", number(df, model.target), shard_rows)
    mean, std, maps = shards.mean, shards.std, None
    if p["kernel"] == "linear":
        # A network without hidden layers: the inputs as they are.
        model.extra["shapes"], size = network_shapes(width, []), width + 1
    else:
        gamma = p["gamma"] if isinstance(p.get("gamma"), float) else 1.0 / width
        model.extra["fourier"] = {"width": width, "size": fourier_size, "gamma": gamma, "seed": SEED}
        maps, size = fourier_map(**model.extra["fourier"]), fourier_size + 1

    def lift(x: np.ndarray) -> np.ndarray:
        x = (x - mean) / std
        z = fourier(x, *maps) if maps else x
        return np.column_stack([z, np.ones(len(z))])

    try:
        fitted = fit_svr(
            shards,
            lift,
            size,
            shards.target,
            float(p["C"]),
            float(p.get("epsilon", 0.1)),
            min(int(p.get("max_iter", 1000)), max_jobs or 10**9),
            float(p.get("tol", 1e-3)),
        )
    finally:
        shards.release()
    centre, spread = shards.target
    model.extra.update({"weights": fitted.weights.tolist(), "mean": [*mean.tolist(), centre], "std": [*std.tolist(), spread]})
    model.extra.update({"gap": fitted.gap, "objective": fitted.primal, "trace": fitted.trace})
    return model


def _fit_planes(labelled: DataFrame, model: Model, p: dict, max_jobs: int | None, shard_rows: int) -> Model:
    """Support vector classification on standardised inputs, one class against the others."""
    missing = labelled.filter(F.exists(vector_to_array("features"), F.isnan)).count()
    if missing:
        raise ValueError(f"svm_classifier: {missing} rows have a missing feature")
    shards, kernel = deal(labelled, "features", F.col("_label"), shard_rows), model.extra.get("fourier")
    try:
        if kernel:
            maps, (centre, width) = fourier_map(**kernel["map"]), (np.array(kernel[k]) for k in ("mean", "std"))
            raw = lambda x: fourier((x - centre) / width, *maps)
            mean, std = moments(shards, raw, kernel["map"]["size"])
        else:
            raw, mean, std = (lambda x: x), shards.mean, shards.std

        def lift(x: np.ndarray) -> np.ndarray:
            return np.column_stack([(raw(x) - mean) / std, np.ones(len(x))])

        rounds = min(int(p.get("max_iter", 1000)), max_jobs or 10**9)
        found = fit_svc(shards, lift, len(mean) + 1, len(model.labels), float(p.get("C", 1.0)), rounds)
    finally:
        shards.release()
    # Planes over the inputs before they were standardised.
    slopes = [f.weights[:-1] / std for f in found]
    model.extra["planes"] = [[*s.tolist(), float(f.weights[-1] - s @ mean)] for s, f in zip(slopes, found)]
    model.extra.update({"gaps": [f.gap for f in found], "objectives": [f.primal for f in found]})
    return model


def _fit_network(labelled: DataFrame, model: Model, p: dict, max_jobs: int | None, shard_rows: int) -> Model:
    """A classifier network on standardised inputs."""
    # An epoch of long shards takes more steps than one of many shards, so fewer epochs are needed.
    shards = deal(labelled, "features", F.col("_label"), shard_rows, few=True)
    shapes = tuple(zip([len(shards.mean), *p["hidden_layer_sizes"]], [*p["hidden_layer_sizes"], len(model.labels)]))
    rate = p["learning_rate"] if isinstance(p.get("learning_rate"), float) else Net.rate
    net = Net(
        shapes,
        float(p.get("alpha", Net.alpha)),
        tuple(p.get("dropout", ())),
        rate,
        int(p.get("batch_size", Net.batch)),
        p["random_state"],
    )
    try:
        w, trace = fit_network(shards, net, min(p["max_iter"], max_jobs or 10**9), float(p.get("tol", 1e-4)))
    finally:
        shards.release()
    model.extra = {"weights": w.tolist(), "mean": shards.mean.tolist(), "std": shards.std.tolist()}
    model.extra.update({"shapes": [list(s) for s in shapes], "losses": trace})
    return model


def _fit_trees(table: DataFrame, model: Model, p: dict, target: Any, classes: int) -> Model:
    """A tree, or a forest of bootstrapped ones, on rows that have a target."""
    forest = model.algorithm.startswith("random_forest")
    typed = table.select(vector_to_array("features").alias("x"), target.cast("double").alias("y"))
    kept = typed.filter(F.col("y").isNotNull() & ~F.isnan("y")).select(F.monotonically_increasing_id().alias("row"), "x", "y")
    rows = settle(kept)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = width or len(model.features)
    share = float(p.get("min_samples_split", 2))
    growth = Growth(
        classes=classes,
        width=width,
        max_depth=int(p.get("max_depth") or DEEPEST),
        min_split=max(2, int(np.ceil(share * n)) if share < 1 else int(share)),
        min_leaf=max(1, int(p.get("min_samples_leaf", 1))),
        criterion="gini" if p.get("criterion", "gini") == "gini" else "entropy",
        trees=p["n_estimators"] if forest else 1,
        features=max(1, int(np.sqrt(width))) if forest and classes else 0,
        bootstrap=forest,
        bins=int(p.get("max_bins", FOREST_BINS)) if forest else 0,
        seed=p.get("random_state", SEED),
        local_bytes=int(p.get("local_bytes", LOCAL_BYTES)),
    )
    edges = quantile_edges(rows, width, growth.bins) if growth.bins and 8 * n * (width + 2) > growth.local_bytes else []
    if forest:
        # Every tree draws and routes all rows, so they are spread evenly over the cores.
        tasks = min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // SPREAD_ROWS))
        rows = rows.repartition(max(1, tasks), "row").sortWithinPartitions("row").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model.extra["trees"] = packed(fit_trees(rows, growth, edges), growth)
    finally:
        rows.unpersist()
    return model


def fit_dense_network(df: DataFrame, features: list[str], target: str, max_iter: int = 1000) -> Model:
    """The 128-64-32 classifier network with its dropout."""
    sizes = {"hidden_layer_sizes": tuple(DENSE_NETWORK), "dropout": tuple(DENSE_DROPOUT), "max_iter": max_iter}
    return fit(df, "neural_network_classifier", features, target, sizes)


def explained_variance(spark: SparkSession, model: Model) -> DataFrame:
    """``(component, ratio, cumulative)`` of a PCA model."""
    ratios = np.array(model.extra["explained"])
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, np.cumsum(ratios)))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def score_records(model: Model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score a table of named records; absent features count as 0."""
    return model.score(align_features(df, model.features, keep))


def score_arrays(model: Model, df: DataFrame, array: str, keep: list[str] | None = None) -> DataFrame:
    """Score rows holding their features as one array of the right length."""
    width = len(model.features)
    checked = F.when(F.size(col(array)) == width, col(array)).otherwise(
        F.raise_error(F.format_string(f"Expected {width} features, got %d", F.size(col(array))))
    )
    named = df.withColumn("_checked", checked)
    return model.score(
        named.select(
            *[col(c) for c in keep or []],
            *[F.col("_checked")[i].cast("double").alias(c) for i, c in enumerate(model.features)],
        )
    )


def feature_columns(df: DataFrame, target: str | None, exclude: list[str] | None = None) -> list[str]:
    """Numeric and boolean columns other than the target."""
    skip = {target, *(exclude or [])}
    return [f.name for f in df.schema.fields if f.name not in skip and family(f.dataType) in ("numeric", "boolean")]
