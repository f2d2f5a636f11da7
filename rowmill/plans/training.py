"""Training, evaluation, comparison and grid search as Spark plans."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.operators import classification, clustering, distribution, learn, regression
from rowmill.operators.board import comparison_metric, parameter_grid, rank_models, ranking_summary
from rowmill.operators.split import with_split
from rowmill.operators.steps import Chain, align_features
from rowmill.plans.prepare import prepare
from rowmill.sources import registry
from rowmill.sources.readers import load_table
from rowmill.sources.writers import append_results, metric_rows

# Fields a training request must have; the names under which
# metrics are reported; job stages with their progress.
T = TypeVar("T")
#: Trials of a search that run at the same time.
PARALLEL = 4

REQUIRED = ("algorithm", "target_column")
METRIC_NAMES = {"f1": "f1_score"}
STAGES = {
    "initializing": 5.0,
    "loading_data": 10.0,
    "preprocessing": 30.0,
    "preparing_ml_data": 40.0,
    "training": 50.0,
    "evaluating": 80.0,
    "saving": 90.0,
    "completed": 100.0,
}
STAGE_NOTES = {
    "preprocessing": "Splitting rows and preparing columns",
    "preparing_ml_data": "Choosing features",
    "training": "Training model",
    "evaluating": "Evaluating model",
}


@dataclass
class Trained:
    """``chain`` prepares raw rows as the test rows were prepared."""

    model: learn.Model
    metrics: DataFrame
    train_rows: int
    test_rows: int
    chain: Chain | None = None


def evaluate(model: learn.Model, test: DataFrame, key: str | None = None, exact: bool = False) -> DataFrame:
    """``(model, metric, value)`` rows for a scored table, by model kind.

    A clustering's silhouette is that of a sample against all rows, with its
    standard error; ``exact`` measures every pair (by row ``key``), which is quadratic.
    """
    name = model.algorithm
    if model.kind == "dimensionality_reduction":
        ratios = model.extra["explained"]
        rows = [(name, "n_components", float(len(ratios))), (name, "total_variance_explained", float(sum(ratios)))]
        return test.sparkSession.createDataFrame(rows, "model string, metric string, value double")
    scored = model.score(test)
    if model.kind == "classification":
        scored = scored.withColumn(model.target, F.col(model.target).cast("string"))
        table = classification.class_metrics(scored, model.target, "prediction")
    elif model.kind == "regression":
        table = regression.regression_metrics(settle(scored.select(model.target, "prediction")), model.target, "prediction")
    else:
        numbered = scored if key else scored.withColumn("_row", F.monotonically_increasing_id())
        features = model.features[0] if len(model.features) == 1 and scored.schema[model.features[0]].dataType.typeName() == "array" else model.features
        held = settle(clustering.as_points(numbered, key or "_row", "prediction", features))
        table = clustering.silhouette_sampled(held)
        if exact:
            table = clustering.silhouette(held).withColumn("n_clusters", F.lit(table.first()["n_clusters"]))
        table = table.withColumnRenamed("silhouette", "silhouette_score")
    for old, new in METRIC_NAMES.items():
        if old in table.columns:
            table = table.withColumnRenamed(old, new)
    return metric_rows(table, model=name)


def detailed_analysis(model: learn.Model, scored: DataFrame) -> DataFrame:
    """Distribution of the actual and the predicted values."""
    columns = [model.target, "prediction"]
    if model.kind == "classification":
        text = scored.select(*[F.col(c).cast("string").alias(c) for c in columns])
        return distribution.categorical_distribution(text, columns)
    return distribution.numeric_distribution(scored, columns)


@dataclass
class Ready:
    """Prepared training and test rows of one request."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    chain: Chain


def make_ready(df: DataFrame, config: dict, key: str) -> Ready:
    """Split, and fit the preparation on the training rows only.

    ``key`` identifies rows; it takes part in the split and is no feature.
    """
    for name in REQUIRED:
        if name not in config:
            raise ValueError(f"Missing required field: {name}")
    target = config["target_column"]
    split = settle(with_split(df, key, target, config.get("test_size", 0.2)))
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    prep = {"remove_duplicates": False, **config.get("preprocessing", {}), "target_column": target}
    fitted = prepare(train.drop(key), prep)
    ready = settle(fitted.table)
    features = learn.feature_columns(ready, target)
    typed = ready.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], target)
    # Steps that leave out rows are for training only.
    chain = Chain([s for s in fitted.chain.steps if s.kind not in ("drop_duplicates", "outliers")])
    held_out = settle(align_features(chain.transform(test.drop(key)), features, [target]))
    return Ready(typed, held_out, features, chain)


def train_table(df: DataFrame, config: dict, key: str, told: Callable[[str], None] = lambda stage: None) -> Trained:
    """Split, fit the preparation on the training rows, fit, evaluate; ``told``
    hears of each stage as it begins."""
    told("preprocessing")
    ready = make_ready(df, config, key)
    told("preparing_ml_data")
    # The features are known: the last check before the fit.
    if not ready.features:
        raise ValueError("no numeric or boolean feature is left")
    told("training")
    model = learn.fit(ready.train, config["algorithm"], ready.features, config["target_column"], config.get("parameters"))
    told("evaluating")
    metrics = settle(evaluate(model, ready.test))
    return Trained(model, metrics, ready.train.count(), ready.test.count(), ready.chain)


def score_raw(spark: SparkSession, path: str, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Score raw rows with a model and its preparation as ``run_job`` saved
    them; the columns in ``keep`` pass through."""
    model, _ = learn.Model.load(spark, path)
    keep = keep or []
    raw = df if not model.target or model.target in df.columns else df.withColumn(model.target, F.lit(None).cast("string"))
    held = {c: f"_kept_{i}" for i, c in enumerate(keep)}
    # The model's features are the selection.
    steps = [s for s in Chain.load(spark, f"{path}/chain").steps if s.kind != "select"]
    prepared = Chain(steps).transform(raw.withColumns({v: F.col(f"`{c}`") for c, v in held.items()}))
    scored = model.score(align_features(prepared, model.features, list(held.values())))
    return scored.withColumnsRenamed({v: c for c, v in held.items() if c not in model.features})


def run_job(spark: SparkSession, config: dict, root: str) -> str:
    """The whole job over a file: load, train, evaluate, save, record.

    Each stage appends a status row, and a failure is recorded before it is
    raised.
    """
    job, model_id = uuid.uuid4().hex, uuid.uuid4().hex
    seq = 0

    def note(status: str, progress: float, logs: list[str]) -> None:
        nonlocal seq
        seq += 1
        row = {"id": job, "model_id": model_id, "status": status, "progress": progress, "logs": json.dumps(logs)}
        registry.record(spark, root, "jobs", [row], seq)

    started = dt.datetime.now(dt.timezone.utc)
    note("initializing", STAGES["initializing"], ["Initializing training process"])
    row = {
        "id": model_id,
        "name": config.get("model_name", config.get("algorithm")),
        "algorithm": config.get("algorithm"),
        "parameters": json.dumps(config.get("parameters", {})),
        "dataset_id": config.get("dataset_id"),
        "status": "training",
    }
    registry.record(spark, root, "models", [row])
    try:
        note("loading_data", STAGES["loading_data"], ["Loading dataset"])
        df = load_table(spark, config["dataset_path"])
        result = train_table(df, config, config["key_column"], lambda stage: note(stage, STAGES[stage], [STAGE_NOTES[stage]]))
        note("saving", STAGES["saving"], ["Saving trained model"])
        path = f"{root}/saved/{model_id}"
        result.model.save(spark, path, {"job_id": job, "config": config})
        result.chain.save(spark, f"{path}/chain")
        append_results(result.metrics.withColumn("job_id", F.lit(job)), f"{root}/metrics")
        found = {r["metric"]: r["value"] for r in result.metrics.collect()}
        done = {"id": model_id, "status": "trained", "file_path": path, "metrics": json.dumps(found)}
        registry.record(spark, root, "models", [done], 1)
        seconds = (dt.datetime.now(dt.timezone.utc) - started).total_seconds()
        note("completed", STAGES["completed"], [f"Training time: {seconds:.2f} seconds"])
    except Exception as e:
        note("failed", 0.0, [f"Training failed: {e}"])
        registry.record(spark, root, "models", [{"id": model_id, "status": "failed"}], 1)
        raise
    return job


def compare(models: dict[str, learn.Model], test: DataFrame, metric: str = "auto", key: str | None = None):
    """Score every model on one table: ``(ranking, summary)``."""
    scores = None
    for name, model in models.items():
        rows = evaluate(model, test, key).withColumn("model", F.lit(name))
        scores = rows if scores is None else scores.unionByName(rows)
    first = next(iter(models.values()))
    chosen = comparison_metric(first.kind, metric)
    held = settle(scores)
    return rank_models(held, chosen), ranking_summary(held, chosen)


def _trials(spark: SparkSession, grid: dict[str, list], max_trials: int) -> list[tuple[int, dict]]:
    names = list(grid)
    lists = spark.range(1).select(*[F.array(*[F.lit(v) for v in grid[n]]).alias(n) for n in names])
    # At most max_trials rows.
    return [(t["trial_number"], {n: t[n] for n in names}) for t in parameter_grid(lists, names, max_trials).collect()]


def _run_trials(spark: SparkSession, trials: list, work: Callable[[int, dict], T], parallel: int) -> list[T]:
    """``work`` for every trial, ``parallel`` at a time, each in a pool of its own."""

    def run(trial: tuple[int, dict]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial[0]}")
        return work(*trial)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(run), trials))


SCORES = "trial_number int, parameters string, metric string, value double"


def grid_search(
    df: DataFrame,
    algorithm: str,
    features: list[str],
    target: str,
    grid: dict[str, list],
    test: DataFrame,
    max_trials: int = 10,
    parallel: int = PARALLEL,
) -> DataFrame:
    """One fit per trial over one written table: ``(trial_number, parameters,
    metric, value)``."""
    spark, held, held_out = df.sparkSession, settle(df), settle(test)

    def work(number: int, given: dict) -> list[tuple]:
        model = learn.fit(held, algorithm, features, target, given)
        text = json.dumps(given, sort_keys=True)
        return [(number, text, r["metric"], r["value"]) for r in evaluate(model, held_out).collect()]

    found = _run_trials(spark, _trials(spark, grid, max_trials), work, parallel)
    return spark.createDataFrame([row for rows in found for row in rows], SCORES)


def search(
    df: DataFrame, config: dict, grid: dict[str, list], key: str, root: str, max_trials: int = 10, parallel: int = PARALLEL
) -> str:
    """A recorded search: its id.

    The table is prepared once.  Every trial is a job and a model in the
    registry under ``root``, tagged with the search and its number; a trial that
    fails is recorded as failed and the others go on.  The search's row
    holds the request, the grid, the jobs and the best trial.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    ready = make_ready(df, config, key)
    trials = _trials(spark, grid, max_trials)
    jobs = {number: uuid.uuid4().hex for number, _ in trials}
    request = {
        "id": name,
        "base_config": json.dumps(config, default=str),
        "param_grid": json.dumps(grid, default=str),
        "job_ids": json.dumps([jobs[n] for n, _ in trials]),
        "total_trials": len(trials),
        "status": "running",
    }
    registry.record(spark, root, "searches", [request])

    def work(number: int, given: dict) -> tuple:
        try:
            model = learn.fit(ready.train, config["algorithm"], ready.features, config["target_column"], {**config.get("parameters", {}), **given})
            model.save(spark, f"{root}/saved/{jobs[number]}", {"search_id": name, "trial_number": number})
            return number, given, {r["metric"]: r["value"] for r in evaluate(model, ready.test).collect()}, None
        except Exception as e:  # noqa: BLE001  (recorded with the trial)
            return number, given, {}, str(e)

    found = _run_trials(spark, trials, work, parallel)
    models, rows = [], []
    for number, given, metrics, error in found:
        tag = {"search_id": name, "trial_number": number}
        status = "failed" if error else "trained"
        models.append(
            {
                "id": jobs[number],
                "name": f"trial {number}",
                "algorithm": config["algorithm"],
                "parameters": json.dumps(given, sort_keys=True),
                "file_path": None if error else f"{root}/saved/{jobs[number]}",
                "status": status,
                "metrics": json.dumps(metrics),
            }
        )
        log = json.dumps([tag, error] if error else [tag])
        done = "failed" if error else "completed"
        rows.append({"id": jobs[number], "model_id": jobs[number], "status": done, "progress": 0.0 if error else 100.0, "logs": log})
    registry.record(spark, root, "models", models)
    registry.record(spark, root, "jobs", rows)
    scored = [(str(n), m, v) for n, _, metrics, _ in found for m, v in metrics.items()]
    scores = spark.createDataFrame(scored, "model string, metric string, value double")
    chosen = comparison_metric(learn.kind_of(config["algorithm"]), config.get("metric", "auto"))
    best = rank_models(scores, chosen).filter("rank = 1").first()
    done = {"id": name, "status": "completed" if best else "failed", "best_trial": int(best["model"]) if best else None}
    registry.record(spark, root, "searches", [done], 1)
    return name
