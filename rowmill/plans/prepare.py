"""The configurable preparation chain and its report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rowmill.functions.columns import nan_to_null, numeric_columns
from rowmill.functions.storage import settle
from rowmill.operators.encode import fit_encode
from rowmill.operators.features import fit_features, fit_squares
from rowmill.operators.missing import fit_drop_sparse, fit_impute
from rowmill.operators.outliers import fit_outliers
from rowmill.operators.profile import duplicate_rows
from rowmill.operators.scale import fit_scale
from rowmill.operators.select import fit_select
from rowmill.operators.steps import Chain, Step

# Which steps run when the configuration does not say.
DEFAULTS = {
    "handle_missing": True,
    "missing_strategy": "auto",
    "missing_threshold": 0.5,
    "remove_duplicates": True,
    "handle_outliers": False,
    "outlier_method": "iqr",
    "outlier_threshold": 1.5,
    "feature_engineering": False,
    "feature_engineering_config": {},
    "encode_categorical": True,
    "encoding_method": "auto",
    "target_column": None,
    "scale_features": True,
    "scaling_method": "standard",
    "feature_selection": False,
    "feature_selection_method": "auto",
    "max_features": None,
}


@dataclass
class Prepared:
    table: DataFrame
    chain: Chain
    report: DataFrame


def prepare(df: DataFrame, config: dict | None = None) -> Prepared:
    """Fit and apply missing -> duplicates -> outliers -> features -> encode ->
    scale -> select.  The target takes part in encoding and scoring but is
    itself never filled, encoded or scaled.
    """
    cfg = {**DEFAULTS, **(config or {})}
    spark = df.sparkSession
    target = cfg["target_column"]
    protect = [target] if target else []
    steps: list[Step] = []
    notes: list[tuple[str, str]] = []
    source = nan_to_null(df)
    now = source

    def add(step: Step, note: str, detail: str = "") -> None:
        nonlocal now
        steps.append(step)
        now = step.transform(now)
        if note:
            notes.append((note, detail))

    if cfg["handle_missing"]:
        sparse = fit_drop_sparse(now, cfg["missing_threshold"], protect)
        add(sparse, "", "")
        dropped = ",".join(sparse.state["columns"])
        add(fit_impute(now, cfg["missing_strategy"], protect=protect), "missing_values_handled", dropped)
    if cfg["remove_duplicates"]:
        removed = duplicate_rows(now).first()[0]
        if removed:
            add(Step("drop_duplicates"), "duplicates_removed", str(removed))
            # The distinct rows feed every later fit: shuffle for them once.
            now = settle(now)
    if cfg["handle_outliers"]:
        numeric = [c for c in numeric_columns(now) if c not in protect]
        fitted = fit_outliers(now, cfg["outlier_method"], cfg["outlier_threshold"], numeric)
        add(fitted, "outliers_handled", cfg["outlier_method"])
    if cfg["feature_engineering"]:
        fitted = fit_features(now, cfg["feature_engineering_config"], protect=protect)
        add(fitted, "features_engineered", ",".join(f["name"] for f in fitted.state["new"]))
    if cfg["encode_categorical"]:
        fitted = fit_encode(now, cfg["encoding_method"], target)
        add(fitted, "categorical_encoded", ",".join(f"{p['column']}:{p['method']}" for p in fitted.state["plan"]))
    if cfg["scale_features"]:
        add(fit_scale(now, cfg["scaling_method"], protect=protect), "features_scaled", cfg["scaling_method"])
    if cfg["feature_selection"]:
        fitted = fit_select(now, target, cfg["feature_selection_method"], cfg["max_features"])
        add(fitted, "features_selected", ",".join(fitted.state["columns"]))
    return Prepared(now, Chain(steps), _report(spark, df, now, notes))


def prepare_basic(df: DataFrame, config: dict | None = None) -> Prepared:
    """The short chain: fill (mean / median / 0), label codes, scaling, then
    squares and one product."""
    cfg = {"missing_strategy": "mean", "scaling_method": "standard", **(config or {})}
    target = cfg.get("target_column")
    protect = [target] if target else []
    steps: list[Step] = []
    notes: list[tuple[str, str]] = []
    now = nan_to_null(df)

    def add(step: Step, note: str) -> None:
        nonlocal now
        steps.append(step)
        now = step.transform(now)
        notes.append((note, ""))

    if cfg.get("handle_missing", True):
        strategy = cfg["missing_strategy"]
        strategy = strategy if strategy in ("mean", "median") else "constant"
        add(fit_impute(now, strategy, protect=protect), "missing_values_handled")
    if cfg.get("encode_categorical", True):
        add(fit_encode(now, "label", target), "categorical_encoded")
    if cfg.get("scale_features", True):
        method = "minmax" if cfg["scaling_method"] == "minmax" else "standard"
        add(fit_scale(now, method, protect=protect), "features_scaled")
    if cfg.get("feature_engineering"):
        add(fit_squares(now, cfg, protect), "features_engineered")
    return Prepared(now, Chain(steps), _report(df.sparkSession, df, now, notes))


def _report(spark, before: DataFrame, after: DataFrame, notes: list[tuple[str, str]]) -> DataFrame:
    """``(position, step, detail)``; the first and last rows give the shapes."""

    def shape(df: DataFrame) -> str:
        return f"{df.count()} rows, {len(df.columns)} columns"

    rows = [("original_shape", shape(before)), *notes, ("final_shape", shape(after))]
    return spark.createDataFrame(
        [(i, n, d) for i, (n, d) in enumerate(rows)], "position int, step string, detail string"
    )
