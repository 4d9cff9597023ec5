"""Training runs: single run, group-aware cross-validation, grid search, top-k validation, probe."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import decision_at
from ..operators.evaluation import classification_report, confusion, with_binary_metrics
from ..operators.features import FeatureSpec, check_features, compress_patterns, fit_preprocessor
from ..operators.fold_fits import fit_folds
from ..operators.frames import sort_top_k
from ..operators.models import FittedModel, ModelConfig, coefficient_table, fit_logistic, fit_table, score_fits
from ..operators.splits import SEED, stratified_folds
from ..operators.summaries import CV_COLUMNS, TOP_ORDER, cv_summary, grid_summary
from ..operators.validation import (
    MODEL_KEYS,
    TrainingSet,
    Validation,
    counts_at,
    group_training_set,
    holdout_training_set,
    score_test,
    validate,
)
from ..session import cut_lineage

# Search grid and features of the shortcut probe.
GRID_C = (0.01, 0.1, 1.0, 10.0)
GRID_L1_RATIO = (0.0, 1.0)
GRID_CLASS_WEIGHT = (None, "balanced")
PROBE_FEATURES = ("n_words", "n_chars", "n_sentences", "digit_ratio", "upper_ratio", "punct_ratio")


@dataclass(frozen=True)
class SingleRun:
    """Tables of one train/test run."""

    metrics: DataFrame
    metrics_at_best: DataFrame
    report: DataFrame
    thresholds: DataFrame
    coefficients: DataFrame
    scored: DataFrame
    validation: Validation


def single_run(
    signals: DataFrame, config: ModelConfig = ModelConfig(class_weight="balanced"), spec: FeatureSpec = FeatureSpec(), **split
) -> SingleRun:
    """Stratified split, inner threshold sweep, fit on the whole train side, test at the best threshold."""
    data = holdout_training_set(signals, spec, **split)
    outcome = validate(data, [config])
    report = classification_report(counts_at(outcome.metrics, "best_"), MODEL_KEYS)
    coefficients = coefficient_table(signals.sparkSession, outcome.fits)
    return SingleRun(
        outcome.results, outcome.best_t_results, report, outcome.thresholds, coefficients, score_test(data, outcome.fits), outcome
    )


@dataclass(frozen=True)
class CrossValidation:
    """Tables of a cross-validation run."""

    results: DataFrame
    best_t_results: DataFrame
    thresholds: DataFrame
    summary: DataFrame
    coefficients: DataFrame
    validation: Validation


def group_cross_validation(
    signals: DataFrame,
    split_mode: str = "group_kfold",
    n_splits: int = 5,
    config: ModelConfig = ModelConfig(class_weight="balanced"),
    spec: FeatureSpec = FeatureSpec(),
    **split,
) -> CrossValidation:
    """Per split: fit, metrics at 0.5, inner threshold, metrics at the best threshold; summary over splits."""
    data = group_training_set(signals, spec, split_mode, n_splits, **split)
    outcome = validate(data, [config])
    return CrossValidation(
        outcome.results,
        outcome.best_t_results,
        outcome.thresholds,
        cv_summary(outcome.results, columns=CV_COLUMNS),
        coefficient_table(signals.sparkSession, outcome.fits),
        outcome,
    )


def parameter_grid(
    c: Sequence[float] = GRID_C,
    l1_ratio: Sequence[float] = GRID_L1_RATIO,
    class_weight: Sequence[str | None] = GRID_CLASS_WEIGHT,
) -> list[ModelConfig]:
    return [ModelConfig(C=a, l1_ratio=b, class_weight=w) for a, b, w in product(c, l1_ratio, class_weight)]


@dataclass(frozen=True)
class GridSearch:
    """Per-split results, per-configuration summary and the best configurations."""

    results: DataFrame
    summary: DataFrame
    top: DataFrame
    thresholds: DataFrame
    configs: tuple[ModelConfig, ...]


def grid_search(
    signals: DataFrame,
    configs: Sequence[ModelConfig] | None = None,
    n_splits: int = 30,
    top_k: int = 3,
    spec: FeatureSpec = FeatureSpec(),
    **split,
) -> GridSearch:
    """Every configuration on every group-shuffle split; the best by q25, median and mean F2."""
    configs = tuple(configs if configs is not None else parameter_grid())
    data = group_training_set(signals, spec, "group_shuffle", n_splits, **split)
    outcome = validate(data, configs)
    summary = grid_summary(outcome.results)
    _, top = sort_top_k(
        summary, TOP_ORDER, ["config_id", "C", "l1_ratio", "class_weight", *TOP_ORDER], top_k, tie_break="config_id"
    )
    return GridSearch(outcome.results, summary, top, outcome.thresholds, configs)


def validate_top(
    signals: DataFrame,
    top: DataFrame,
    n_folds: int = 5,
    spec: FeatureSpec = FeatureSpec(),
    **split,
) -> Validation:
    """The best configurations on group k-fold splits, tested at their own best thresholds.

    ``config_id`` of the outcome is the position in ``top`` (0 = best).
    """
    rows = top.select("C", "l1_ratio", "class_weight").collect()  # k rows
    configs = [
        ModelConfig(C=r["C"], l1_ratio=r["l1_ratio"], class_weight=None if r["class_weight"] == "None" else r["class_weight"])
        for r in rows
    ]
    data: TrainingSet = group_training_set(signals, spec, "group_kfold", n_folds, **split)
    return validate(data, configs)


def final_model(
    signals: DataFrame, config: ModelConfig = ModelConfig(class_weight="balanced"), spec: FeatureSpec = FeatureSpec()
) -> FittedModel:
    """One MLlib model on all rows, ready to be saved with its preparation."""
    patterns = cut_lineage(compress_patterns(signals, spec))
    return fit_logistic(patterns, fit_preprocessor(patterns, spec), config)


def shortcut_probe(
    metrics: DataFrame,
    key: str = "case_id",
    label_col: str = "label",
    n_folds: int = 5,
    seed: int = SEED,
    features: Sequence[str] = PROBE_FEATURES,
) -> DataFrame:
    """How well surface metrics alone predict the label: F1 per fold, mean and population std.

    Surface metrics hardly repeat, so there are no patterns to compress: all folds are fitted together over the rows, which
    stay in the JVM.
    """
    spec = FeatureSpec(tuple(features), ())
    # Written once: the fold draw starts from it.
    narrow = cut_lineage(metrics.select(key, *features, F.col(label_col).alias("label")))
    folded = stratified_folds(narrow, key, "label", n_folds, seed)
    table = cut_lineage(folded.withColumn("weight", F.lit(1)))
    check_features(table, spec, 0)
    models = fit_folds(table, features, n_folds)
    fits = fit_table(metrics.sparkSession, {(0, f): m for f, m in models.items()})
    scored = score_fits(table.withColumnRenamed("fold", "split_id"), fits, spec)
    decided = scored.withColumn("prediction", decision_at("score", 0.5))
    per_fold = with_binary_metrics(confusion(decided, ["split_id"], weight_col="weight"))
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std")
    )
