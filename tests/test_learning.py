"""Invariants of the fitted models; no agreement with other solvers is claimed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowmill.operators import learn as L
from rowmill.plans import training as T
from rowmill.plans.catalog import base, learning


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 2)) * 0.4 + np.stack([y * 3.0, (y == 1) * 4.0], axis=1)
    rows = [(i, f"c{c}", float(a), float(b), float(2 * a - b + 1)) for i, (c, (a, b)) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id int, y string, a double, b double, t double").coalesce(2).cache()


@pytest.mark.parametrize("name", [k for k, v in L.ALGORITHMS.items() if v[0] == "classification"])
def test_classifiers_separate_blobs(blobs, name):
    small = {"n_estimators": 5, "hidden_layer_sizes": (8,)}
    model = L.fit(blobs, name, ["a", "b"], "y", small)
    scored = model.score(blobs)
    assert scored.filter("prediction = y").count() > 225
    if "probability" in scored.columns:
        assert scored.first()["probability"] is not None and len(scored.first()["probability"]) == 3


@pytest.mark.parametrize("name", [k for k, v in L.ALGORITHMS.items() if v[0] == "regression"])
def test_regressors_beat_the_mean(blobs, name):
    model = L.fit(blobs, name, ["a", "b"], "t", {"n_estimators": 5, "hidden_layer_sizes": (8,)}, max_jobs=30)
    metrics = {r["metric"]: r["value"] for r in T.evaluate(model, blobs).collect()}
    assert metrics["r2_score"] > 0.9
    if "trace" in model.extra:
        trace = model.extra["trace"]
        assert all(b <= a for a, b in zip(trace, trace[1:])) and trace[-1] < trace[0]


def test_equal_seeds_give_equal_models(blobs):
    one, two = (L.fit(blobs, "neural_network_regressor", ["a", "b"], "t", {"hidden_layer_sizes": (4,)}, 5) for _ in range(2))
    assert np.allclose(one.extra["weights"], two.extra["weights"])


@pytest.mark.parametrize("name", ["kmeans", "hierarchical_clustering"])
def test_clusterers_find_the_blobs(blobs, name):
    scored = L.fit(blobs, name, ["a", "b"]).score(blobs)
    pairs = scored.groupBy("y", "prediction").count().collect()
    assert len(pairs) == 3 and sum(r["count"] for r in pairs) == 240


def test_ward_merges_the_closest_pair():
    centres = np.array([[0.0], [0.1], [5.0], [9.0]])
    assert L._ward(centres, np.ones(4), 3) == [0, 0, 1, 2]


def test_pca_components_are_centred_and_signed(blobs):
    model = L.fit(blobs, "pca", ["a", "b"])
    c = np.array([r["components"] for r in model.score(blobs).collect()])
    assert np.allclose(c.mean(0), 0, atol=1e-9) and sum(model.extra["explained"]) == pytest.approx(1)
    assert abs(np.corrcoef(c.T)[0, 1]) < 1e-9


@pytest.mark.parametrize("name", ["random_forest_classifier", "svm_regressor", "hierarchical_clustering", "pca"])
def test_models_reload(spark, blobs, tmp_path, name):
    target = {"classification": "y", "regression": "t"}.get(L.kind_of(name))
    model = L.fit(blobs, name, ["a", "b"], target, {"n_estimators": 3}, max_jobs=3)
    model.save(spark, str(tmp_path / name), {"note": 1})
    again, meta = L.Model.load(spark, str(tmp_path / name))
    out = "components" if name == "pca" else "prediction"
    assert meta == {"note": 1}
    assert model.score(blobs).orderBy("id").select(out).collect() == again.score(blobs).orderBy("id").select(out).collect()


def test_parameters_are_clamped_and_filtered():
    got = L.parameters_for("random_forest_classifier", {"max_depth": -3, "n_estimators": "7", "bogus": 1})
    assert got == {"n_estimators": 7, "random_state": 42, "max_depth": 1}
    assert L.parameters_for("logistic_regression", {"C": 0, "max_iter": 5})["max_iter"] == 100
    with pytest.raises(ValueError):
        L.parameters_for("nothing")


def test_array_scoring_checks_the_length(spark, blobs):
    model = L.fit(blobs, "linear_regression", ["a", "b"], "t")
    good = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert L.score_arrays(model, good, "x").first()["prediction"] == pytest.approx(1.0)
    with pytest.raises(Exception, match="Expected 2 features"):
        L.score_arrays(model, spark.createDataFrame([([1.0],)], "x array<double>"), "x").collect()


def test_records_fill_absent_features(spark, blobs):
    model = L.fit(blobs, "linear_regression", ["a", "b"], "t")
    row = spark.createDataFrame([(3.0, "x")], "a double, extra string")
    assert L.score_records(model, row).first()["prediction"] == pytest.approx(7.0)


def test_importances_sum_to_one(spark, blobs):
    model = L.fit(blobs, "decision_tree_classifier", ["a", "b"], "y")
    assert model.importances(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_compare_ranks_and_summarises(blobs):
    models = {"full": L.fit(blobs, "linear_regression", ["a", "b"], "t"), "half": L.fit(blobs, "linear_regression", ["b"], "t")}
    ranking, summary = T.compare(models, blobs)
    assert [r["model"] for r in ranking.orderBy("rank").collect()] == ["full", "half"]
    assert summary.first()["total_models"] == 2


def test_dense_network_layers(blobs):
    model = L.fit_dense_network(blobs, ["a", "b"], "y", max_iter=100)
    assert model.extra["shapes"] == [[2, 128], [128, 64], [64, 32], [32, 3]] and model.parameters["dropout"] == (0.3, 0.3, 0.0)


def test_job_over_a_file(spark, blobs, tmp_path):
    from rowmill.sources import registry

    path = str(tmp_path / "in.csv")
    blobs.select("id", "y", "a", "b").write.option("header", True).csv(path)
    root = str(tmp_path / "registry")
    config = {"dataset_path": path, "algorithm": "logistic_regression", "target_column": "y", "key_column": "id"}
    job = T.run_job(spark, config, root)
    state = registry.find(spark, root, "jobs", job).first()
    assert (state["status"], state["progress"]) == ("completed", 100.0)
    told = registry.events(spark, root, "jobs").orderBy("event_seq").collect()
    assert [r["status"] for r in told] == list(T.STAGES) and [r["progress"] for r in told] == list(T.STAGES.values())
    model = registry.state(spark, root, "models").first()
    assert model["status"] == "trained" and "accuracy" in model["metrics"]
    scored = T.score_raw(spark, model["file_path"], blobs.select("id", "a", "b"), ["id"])
    assert scored.join(blobs.select("id", "y"), "id").filter("prediction = y").count() > 225
    with pytest.raises(ValueError, match="Missing required field"):
        T.run_job(spark, {k: v for k, v in config.items() if k != "target_column"}, root)
    assert registry.state(spark, root, "jobs").filter("status = 'failed'").count() == 1


def test_full_reports_are_saved(spark, blobs, tmp_path):
    from rowmill.plans.report import evaluation_report

    small = {"hidden_layer_sizes": (8,), "max_depth": 4, "n_clusters": 3}
    cases = {
        "decision_tree_classifier": ("y", {"confusion_matrix", "per_class", "classification_report", "distributions"}),
        "decision_tree_regressor": ("t", {"residuals", "moments", "distributions"}),
        "kmeans": (None, {"cluster_sizes", "clusters"}),
    }
    for name, (target, want) in cases.items():
        path = str(tmp_path / name)
        parts = evaluation_report(L.fit(blobs, name, ["a", "b"], target, small), blobs, path)
        assert set(parts) == want | {"metrics"}
        for part, table in parts.items():
            assert spark.read.parquet(f"{path}/{part}").count() == table.count() > 0
        names = {r["metric"] for r in parts["metrics"].collect()}
        assert names >= {"y": {"accuracy", "roc_auc_macro"}, "t": {"r2_score"}, None: {"silhouette_score", "davies_bouldin"}}[target]
    two = blobs.filter("y <> 'c2'")
    parts = evaluation_report(L.fit(two, "logistic_regression", ["a", "b"], "y"), two)
    found = {r["metric"]: r["value"] for r in parts["metrics"].collect()}
    assert found["roc_auc"] > 0.99 and found["pr_auc"] > 0.99
    assert parts["roc_curve"].columns == ["score", "fpr", "tpr"] and parts["pr_curve"].count() > 2
    brief = evaluation_report(L.fit(two, "logistic_regression", ["a", "b"], "y"), two, detailed=False)
    assert set(brief) == {"metrics", "confusion_matrix"}


def test_search_records_every_trial_and_the_best(spark, blobs, tmp_path):
    from rowmill.sources import registry

    root, config = str(tmp_path), {"algorithm": "decision_tree_classifier", "target_column": "y", "preprocessing": {"scale_features": False}}
    grid = {"max_depth": [1, 6, 40], "criterion": ["gini"]}
    name = T.search(blobs.select("id", "y", "a", "b"), config, grid, "id", root)
    found = registry.find(spark, root, "searches", name).first()
    jobs = json.loads(found["job_ids"])
    assert (found["status"], found["total_trials"], len(jobs)) == ("completed", 3, 3)
    assert json.loads(found["base_config"]) == config and json.loads(found["param_grid"]) == grid
    state = {r["id"]: r for r in registry.jobs_with_models(registry.state(spark, root, "jobs"), registry.state(spark, root, "models")).collect()}
    models = {r["id"]: r for r in registry.state(spark, root, "models").collect()}
    depth = {j: json.loads(models[j]["parameters"])["max_depth"] for j in jobs}
    # Depth 40 is refused: that trial fails, and the others go on.
    assert {depth[j]: state[j]["status"] for j in jobs} == {1: "completed", 6: "completed", 40: "failed"}
    assert depth[jobs[found["best_trial"] - 1]] == 6
    tag = json.loads(state[jobs[0]]["logs"])[0]
    assert tag == {"search_id": name, "trial_number": 1}
    best, meta = L.Model.load(spark, models[jobs[found["best_trial"] - 1]]["file_path"])
    assert meta["search_id"] == name and best.score(blobs).filter("prediction = y").count() > 225


@pytest.mark.parametrize(
    "name, options",
    [
        ("svm_regressor", {"kernel": "poly"}),
        ("svm_classifier", {"kernel": "sigmoid"}),
        ("hierarchical_clustering", {"linkage": "single"}),
        ("hierarchical_clustering", {"affinity": "cosine"}),
        ("logistic_regression", {"penalty": "elasticnet"}),
        ("logistic_regression", {"solver": "saga"}),
        ("neural_network_classifier", {"learning_rate": "invscaling"}),
        ("decision_tree_classifier", {"criterion": "chance"}),
        ("neural_network_regressor", {"learning_rate": "adaptive"}),
        ("random_forest_classifier", {"max_depth": 31}),
    ],
)
def test_options_are_honoured_or_refused(blobs, name, options):
    with pytest.raises(ValueError, match=next(iter(options))):
        L.fit(blobs, name, ["a", "b"], "y", options)


def test_linear_support_vectors_find_the_plane(blobs):
    model = L.fit(blobs, "svm_regressor", ["a", "b"], "t", {"kernel": "linear", "epsilon": 0.001, "C": 1e6}, max_jobs=60)
    off = model.score(blobs).select(F.max(F.abs(F.col("prediction") - F.col("t")))).first()[0]
    assert "fourier" not in model.extra and off < 0.2


def test_hierarchy_says_when_it_is_approximate(blobs):
    corners = blobs.selectExpr("round(a / 3) as a", "round(b / 4) as b")
    assert not L.fit(corners, "hierarchical_clustering", ["a", "b"]).extra["approximate"]
    assert L.fit(blobs, "hierarchical_clustering", ["a", "b"], micro_clusters=20).extra["approximate"]


@pytest.mark.parametrize("name", ["svr", "mlp_reg", "mlp_clf", "dense_network"])
def test_registered_fits_keep_the_defaults(monkeypatch, name):
    class Stop(Exception):
        pass

    def fit(df, algorithm, features, target=None, parameters=None, max_jobs=None, **other):
        asked = L.parameters_for(algorithm, parameters)
        want = L.parameters_for(algorithm, {"hidden_layer_sizes": (128, 64, 32)} if name == "dense_network" else None)
        assert max_jobs is None and not other
        assert {k: asked[k] for k in ("max_iter", "hidden_layer_sizes") if k in asked} == {
            k: want[k] for k in ("max_iter", "hidden_layer_sizes") if k in want
        }
        raise Stop

    monkeypatch.setattr(L, "fit", fit)
    monkeypatch.setattr(learning, "_orders", lambda spark, sf: (None, None))
    with pytest.raises(Stop):
        base.QUERIES[name](None, "")


def test_randomised_components_against_numpy(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").filter("size(embedding) = 64").select("vec_id", "embedding")
    x = np.array([r["embedding"] for r in df.collect()], dtype=np.float64)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    asked = {"n_components": 3, "svd_solver": "randomized"}
    model = L.fit(df, "pca", ["embedding"], parameters=asked)
    assert model.extra["residual"] < 1e-6
    assert np.allclose(model.extra["explained"], values[:3] / values.sum(), atol=1e-6)
    full = L.fit(df, "pca", ["embedding"], parameters={"n_components": 3, "svd_solver": "full"})
    a, b = (np.array([r["components"] for r in m.score(df).orderBy("vec_id").collect()]) for m in (model, full))
    assert np.allclose(a, b, atol=1e-3)
    model.save(spark, str(tmp_path / "pca"))
    again = L.Model.load(spark, str(tmp_path / "pca"))[0]
    assert np.array_equal(a, [r["components"] for r in again.score(df).orderBy("vec_id").collect()])
    white = L.fit(df, "pca", ["embedding"], parameters={**asked, "whiten": True}).score(df)
    assert np.allclose(np.array([r["components"] for r in white.collect()]).std(0, ddof=1), 1, atol=1e-6)


def test_components_of_gaps_constants_and_few_columns(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = L.fit(df, "pca", ["a", "b", "c"], parameters={"svd_solver": "randomized"})
    assert model.extra["explained"] == pytest.approx([1, 0], abs=1e-9)
    got = [r["components"] for r in model.score(df).orderBy("b").collect()]
    assert np.isnan(got[0]).all() and got[1][0] == pytest.approx(-(5**0.5))
    flat = L.fit(df.select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), "pca", ["a", "b"], parameters={"svd_solver": "randomized"})
    assert flat.extra["explained"] == [0, 0]
    with pytest.raises(ValueError, match="two rows"):
        L.fit(df.limit(0), "pca", ["a", "b", "c"], parameters={"svd_solver": "randomized"})
    with pytest.raises(ValueError, match="svd_solver"):
        L.fit(df, "pca", ["a", "b"], parameters={"svd_solver": "arpack"})
