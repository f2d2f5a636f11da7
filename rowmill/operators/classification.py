"""Classification metrics, all read off one ``(actual, predicted, n)`` count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col
from rowmill.functions.ordering import running_totals
from rowmill.functions.stats import ratio
from rowmill.functions.storage import settle


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The non-empty cells of the confusion matrix."""
    return df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classes(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Union of actual and predicted classes."""
    cells = pair_counts(df, actual, predicted)
    return cells.select(F.explode(F.array("actual", "predicted")).alias("class")).distinct()


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """All class pairs, empty cells as 0; NULL is a class like any other.  The
    result has classes^2 rows, by definition."""
    cells = settle(pair_counts(df, actual, predicted))
    every = cells.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    # Structs, since collecting a bare NULL would lose it.
    known = every.agg(F.collect_list(F.struct("c")).alias("k")).scalar()
    empty = every.select(F.col("c").alias("actual"), F.explode(known).alias("p")).select(
        "actual", F.col("p.c").alias("predicted"), F.lit(0).cast("bigint").alias("n")
    )
    return cells.unionByName(empty).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def class_margins(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``(class, tp, support, guessed)`` without any join."""
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    hit = F.when(F.col("actual") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), n.alias("support"), zero.alias("guessed")),
        F.struct(F.col("predicted").alias("class"), zero.alias("tp"), zero.alias("support"), n.alias("guessed")),
    )
    return (
        pair_counts(df, actual, predicted)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(k).alias(k) for k in ("tp", "support", "guessed")])
    )


def _prf() -> dict[str, Column]:
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    return {
        "precision": ratio(tp, guessed, 0.0),
        "recall": ratio(tp, support, 0.0),
        "f1": ratio(2 * tp, support + guessed, 0.0),
    }


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class; no division by zero."""
    scores = _prf()
    return class_margins(df, actual, predicted).select(
        "class", *[v.alias(k) for k, v in scores.items()], "support"
    )


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row with every threshold-free class metric."""
    scored = class_margins(df, actual, predicted).withColumns(_prf())
    support = F.col("support").cast("double")
    guessed = F.col("guessed").cast("double")
    sums = scored.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum(support).alias("s"),
        F.sum("tp").cast("double").alias("c"),
        F.sum(support * guessed).alias("tg"),
        F.sum(support * support).alias("tt"),
        F.sum(guessed * guessed).alias("gg"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.sum(F.col(k) * support).alias(f"w_{k}") for k in ("precision", "recall", "f1")],
    )
    s, c, tg = F.col("s"), F.col("c"), F.col("tg")
    spread = F.sqrt((s * s - F.col("gg")) * (s * s - F.col("tt")))
    by_chance = tg / (s * s)
    return sums.filter("s > 0").select(
        "n_classes",
        (c / s).alias("accuracy"),
        *[(F.col(f"w_{k}") / s).alias(k) for k in ("precision", "recall", "f1")],
        "balanced_accuracy",
        ratio(c / s - by_chance, 1 - by_chance).alias("cohen_kappa"),
        ratio(c * s - tg, spread, 0.0).alias("matthews_corrcoef"),
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per-class rows plus accuracy, macro and support-weighted averages."""
    rows = per_class(df, actual, predicted).withColumn("class", F.col("class").cast("string"))
    names = ("precision", "recall", "f1")
    w = F.col("support")
    averages = rows.agg(
        F.struct(*[F.avg(k).alias(k) for k in names], F.sum(w).alias("support")).alias("macro avg"),
        F.struct(*[(F.sum(F.col(k) * w) / F.sum(w)).alias(k) for k in names], F.sum(w).alias("support")).alias(
            "weighted avg"
        ),
        F.struct(*[(F.sum(F.col("recall") * w) / F.sum(w)).alias(k) for k in names], F.sum(w).alias("support")).alias(
            "accuracy"
        ),
    )
    tail = averages.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("class"), *[F.col(k)[x].alias(x) for x in (*names, "support")])
                    for k in ("accuracy", "macro avg", "weighted avg")
                ]
            )
        )
    )
    return rows.unionByName(tail)


def score_steps(df: DataFrame, positive: Column, score: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """Cumulative true and false positives per distinct score, best first.

    Ties collapse before anything is ordered, and the order is range-
    partitioned, so a score shared by most rows is one row here.
    """
    keys = keys or {}
    steps = (
        df.select(score.alias("score"), positive.cast("int").alias("p"), *[v.alias(k) for k, v in keys.items()])
        .filter("score is not null and p is not null")
        .groupBy(*keys, "score")
        .agg(F.sum("p").cast("bigint").alias("pos"), F.sum(1 - F.col("p")).cast("bigint").alias("neg"))
    )
    return running_totals(
        steps, [F.desc("score")], {"tps": F.col("pos"), "fps": F.col("neg")}, keys=list(keys)
    )


def roc_points(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """``(score, fpr, tpr)`` per distinct score."""
    steps = score_steps(df, positive, score)
    totals = steps.agg(F.struct(F.max("tps").alias("p"), F.max("fps").alias("n"))).scalar()
    return steps.select(
        "score",
        ratio(F.col("fps"), totals["n"]).alias("fpr"),
        ratio(F.col("tps"), totals["p"]).alias("tpr"),
    )


def pr_points(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """``(score, precision, recall)`` per distinct score, plus the end point
    of recall 0 and precision 1 (its score is empty)."""
    steps = score_steps(df, positive, score)
    total = steps.agg(F.max("tps")).scalar()
    points = steps.select(
        "score",
        (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
        ratio(F.col("tps"), total).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "score double, precision double, recall double")
    return points.unionByName(end)


def roc_auc(df: DataFrame, positive: Column, score: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """Area under the ROC curve (trapezoid) per key.

    The previous point of the curve is the running total without the own row,
    so no lag over the whole order is needed.
    """
    steps = score_steps(df, positive, score, keys)
    tps, fps, pos, neg = (F.col(k).cast("double") for k in ("tps", "fps", "pos", "neg"))
    return steps.groupBy(*(keys or {})).agg(
        ratio(F.sum(neg * (2 * tps - pos) / 2), F.max(tps) * F.max(fps)).alias("roc_auc"),
        F.max("tps").alias("positives"),
    )


def pr_auc(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over recall."""
    steps = score_steps(df, positive, score)
    tps, fps, pos, neg = (F.col(k).cast("double") for k in ("tps", "fps", "pos", "neg"))
    now = tps / (tps + fps)
    before = F.when(tps + fps > pos + neg, (tps - pos) / (tps + fps - pos - neg)).otherwise(F.lit(1.0))
    return steps.agg(ratio(F.sum(pos * (now + before) / 2), F.max(tps)).alias("pr_auc"))


def roc_auc_ovr(df: DataFrame, actual: str, scores: dict[str, Column]) -> DataFrame:
    """One-vs-rest AUC: macro and support-weighted mean over the classes."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("class"), v.cast("double").alias("score")) for k, v in scores.items()]
    )
    long = df.select(col(actual).alias("actual"), F.explode(pairs).alias("p"))
    by_class = roc_auc(long, F.col("actual") == F.col("p.class"), F.col("p.score"), {"class": F.col("p.class")})
    return by_class.agg(
        F.avg("roc_auc").alias("roc_auc_macro"),
        (F.sum(F.col("roc_auc") * F.col("positives")) / F.sum("positives")).alias("roc_auc_weighted"),
    )
