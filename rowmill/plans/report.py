"""The full evaluation of a fitted model, saved part by part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.storage import settle
from rowmill.operators import classification, clustering, learn, regression
from rowmill.plans import training
from rowmill.sources.writers import metric_rows, write_report


def evaluation_report(
    model: learn.Model, test: DataFrame, path: str | None = None, detailed: bool = True
) -> dict[str, DataFrame]:
    """Tables by name; with ``path`` each is written below it.

    Always ``metrics``.  Classification adds ``confusion_matrix`` and, where the
    model gives probabilities, ranking scores among the metrics; ``detailed``
    adds ``per_class``, ``classification_report``, ``roc_curve`` and ``pr_curve``
    (two classes).  Regression adds ``residuals`` and ``moments``, clustering
    ``cluster_sizes`` and ``clusters``; both kinds of prediction their
    ``distributions``.  Rows without a prediction or a value take no part.
    """
    parts = {"metrics": training.evaluate(model, test)}
    if model.kind == "classification":
        parts |= _classes(model, test, detailed)
    elif model.kind == "regression":
        parts |= _values(model, test, detailed)
    elif model.kind == "clustering":
        parts |= _clusters(model, test, detailed)
    extra = [parts["metrics"], *([parts.pop("_scores")] if "_scores" in parts else [])]
    parts["metrics"] = settle(extra[0] if len(extra) == 1 else extra[0].unionByName(extra[1]))
    if path:
        write_report(parts, path)
    return parts


def _classes(model: learn.Model, test: DataFrame, detailed: bool) -> dict[str, DataFrame]:
    y, p = model.target, "prediction"
    scored = model.score(test).withColumn(y, F.col(f"`{y}`").cast("string"))
    shares = ["probability"] if "probability" in scored.columns else []
    held = settle(scored.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(y, p, *shares))
    out = {"confusion_matrix": classification.confusion_matrix(held, y, p)}
    if detailed:
        out["per_class"] = classification.per_class(held, y, p)
        out["classification_report"] = classification.classification_report(held, y, p)
        out["distributions"] = training.detailed_analysis(model, held)
    if shares and len(model.labels) == 2:
        positive, score = F.col(y) == model.labels[1], F.col("probability")[1]
        areas = classification.roc_auc(held, positive, score), classification.pr_auc(held, positive, score)
        rows = [metric_rows(a, model=model.algorithm) for a in areas]
        out["_scores"] = rows[0].unionByName(rows[1])
        if detailed:
            out["roc_curve"] = classification.roc_points(held, positive, score)
            out["pr_curve"] = classification.pr_points(held, positive, score)
    elif shares:
        scores = {name: F.col("probability")[i] for i, name in enumerate(model.labels)}
        out["_scores"] = metric_rows(classification.roc_auc_ovr(held, y, scores), model=model.algorithm)
    return out


def _values(model: learn.Model, test: DataFrame, detailed: bool) -> dict[str, DataFrame]:
    y, p = model.target, "prediction"
    held = settle(model.score(test).select(F.col(f"`{y}`").alias(y), p).dropna())
    out = {"residuals": regression.residual_stats(held, y, p)}
    if detailed:
        out["moments"] = regression.moments(held, [y, p])
        out["distributions"] = training.detailed_analysis(model, held)
    return out


def _clusters(model: learn.Model, test: DataFrame, detailed: bool) -> dict[str, DataFrame]:
    scored = model.score(test).filter(F.col("prediction").isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    array = len(model.features) == 1 and scored.schema[model.features[0]].dataType.typeName() == "array"
    held = settle(clustering.as_points(scored, "_row", "prediction", model.features[0] if array else model.features))
    out = {"cluster_sizes": clustering.cluster_sizes(held, "cluster")}
    if detailed:
        out["clusters"] = clustering.cluster_analysis(held)
        tables = clustering.davies_bouldin(held), clustering.calinski_harabasz(held)
        rows = [metric_rows(t, model=model.algorithm) for t in tables]
        out["_scores"] = rows[0].unionByName(rows[1])
    return out
