"""Fits over many splits and configurations.

Splits and configurations are columns.  All models are fitted in the same passes, and all scoring
and metrics run in single aggregations keyed by ``(config_id, split_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_draw
from ..functions.labels import decision_at
from ..session import cut_lineage
from .curves import best_threshold, curve_areas, curve_points, score_counts, threshold_sweep
from .evaluation import COUNTS, with_binary_metrics
from .features import FeatureSpec, compress_patterns
from .joint_fit import JointModel, fit_jointly
from .models import FittedModel, ModelConfig, fit_table, score_fits
from .splits import SEED, TEST_SHARE, digest_cuts, fold_roles, group_folds, group_shuffle_splits, group_sizes, stratified_split, with_signature

MODEL_KEYS = ["config_id", "split_id"]


@dataclass(frozen=True)
class TrainingSet:
    """Weighted patterns with the splits that test them.

    ``table`` holds the features, ``label``, ``weight``, ``test_in`` (ids of the splits whose test side holds the
    pattern) and ``held`` (per split, how many of its rows the inner validation draw took from the train side).
    """

    table: DataFrame
    spec: FeatureSpec
    split_ids: tuple[int, ...]
    split_mode: str

    def _train_ids(self) -> Column:
        return F.array_except(F.array(*[F.lit(s) for s in self.split_ids]), F.col("test_in"))

    def train_rows(self) -> DataFrame:
        """Train patterns of every split, with ``split_id``."""
        return self.table.withColumn("split_id", F.explode(self._train_ids()))

    def inner_rows(self) -> DataFrame:
        """Inner validation patterns of every split, with ``split_id``; ``weight`` counts the rows drawn in that split."""
        rows = self.table.withColumn("split_id", F.explode(self._train_ids()))
        return rows.withColumn("weight", F.element_at("held", F.col("split_id"))).filter(F.col("weight") > 0)

    def test_rows(self) -> DataFrame:
        """Test patterns of every split, with ``split_id``."""
        return self.table.withColumn("split_id", F.explode("test_in"))


def inner_draw(rows: DataFrame, n_splits: int, key: str, label_col: str, share: float, seed: int) -> DataFrame:
    """``split_id`` and ``held`` for every row (with ``test_in``) in the train side of every split.

    Each split draws its inner validation rows anew, inside its own train side and stratified there.  Rows
    are compared with one cut per split and label.
    """
    ids = F.array(*[F.lit(s) for s in range(1, n_splits + 1)])
    drawn = rows.withColumn("split_id", F.explode(F.array_except(ids, "test_in")))
    drawn = drawn.withColumn("h", hash_draw("inner", seed, F.col("split_id"), F.col(key)))
    cuts = digest_cuts(drawn.select("split_id", label_col, "h"), ["split_id", label_col], [share])
    # One cut per split and label.
    joined = drawn.join(F.broadcast(cuts.select("split_id", label_col, "cut")), ["split_id", label_col])
    return joined.withColumn("held", F.col("h") <= F.col("cut")).drop("h", "cut")


def _with_inner(rows: DataFrame, spec: FeatureSpec, n_splits: int, mode: str, key: str, share: float, seed: int) -> TrainingSet:
    """Patterns of rows with ``test_in``, and the rows per pattern that each split's inner draw holds out."""
    marked = cut_lineage(with_signature(rows, spec.columns, "_pattern"))
    pattern = ["_pattern", "label"]
    patterns = compress_patterns(marked, spec, "label", ["test_in", "_pattern"])
    held = inner_draw(marked.select(key, "label", "test_in", "_pattern"), n_splits, key, "label", share, seed).filter("held")
    counts = held.groupBy(*pattern, "split_id").agg(F.count(F.lit(1)).alias("n"))
    # At most n_splits entries per pattern.
    per_pattern = counts.groupBy(*pattern).agg(F.map_from_entries(F.collect_list(F.struct("split_id", "n"))).alias("_held"))
    joined = patterns.join(per_pattern, pattern, "left")
    by_split = [F.coalesce(F.try_element_at("_held", F.lit(s)), F.lit(0).cast("bigint")) for s in range(1, n_splits + 1)]
    return _training_set(joined.withColumn("held", F.array(*by_split)).drop("_held", "_pattern"), spec, range(1, n_splits + 1), mode)


def _written_signals(signals: DataFrame, spec: FeatureSpec, key: str, label_col: str) -> DataFrame:
    """Key, features and label, written once: the draws and the patterns all start from them."""
    return cut_lineage(signals.select(key, *spec.columns, F.col(label_col).alias("label")))


def _training_set(table: DataFrame, spec: FeatureSpec, split_ids: Sequence[int], mode: str) -> TrainingSet:
    return TrainingSet(cut_lineage(table), spec, tuple(split_ids), mode)


def holdout_training_set(
    signals: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    key: str = "case_id",
    label_col: str = "label",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> TrainingSet:
    """One stratified train/test split of the rows."""
    rows = _written_signals(signals, spec, key, label_col)
    drawn = stratified_split(rows, key, "label", test_share, seed, salt="holdout", out_col="_role")
    test_in = F.when(F.col("_role") == "test", F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return _with_inner(drawn.withColumn("test_in", test_in).drop("_role"), spec, 1, "stratified", key, test_share, seed)


def group_training_set(
    signals: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    split_mode: str = "group_kfold",
    n_splits: int | None = None,
    key: str = "case_id",
    label_col: str = "label",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> TrainingSet:
    """Splits that keep rows with equal features together.

    A group is a feature signature; splits are drawn on the groups.
    """
    rows = with_signature(_written_signals(signals, spec, key, label_col), spec.columns)
    sizes = cut_lineage(group_sizes(rows, "group_key"))
    if split_mode == "group_shuffle":
        roles = group_shuffle_splits(sizes, n_splits, test_share, seed)
    elif split_mode == "group_kfold":
        folds = group_folds(sizes, n_splits, seed)
        roles = fold_roles(folds, n_splits)
    else:
        raise ValueError(f"unknown split mode: {split_mode}")
    # At most n_splits ids per group.
    test_in = (
        roles.filter(F.col("role") == "test")
        .groupBy("group_key")
        .agg(F.sort_array(F.collect_list(F.col("split_id").cast("int"))).alias("test_in"))
    )
    joined = rows.join(test_in, "group_key", "left").withColumn(
        "test_in", F.coalesce("test_in", F.array().cast("array<int>"))
    )
    return _with_inner(joined.drop("group_key"), spec, n_splits, split_mode, key, test_share, seed)


Fits = dict[tuple[int, int], FittedModel]


def cross_fit(data: TrainingSet, configs: Sequence[ModelConfig], inner: bool = False) -> Fits:
    """One model per configuration and split, all fitted together; ``inner`` leaves the inner
    validation side out."""
    keys = [(c, s) for c in range(len(configs)) for s in data.split_ids]
    models = [JointModel(configs[c], s, inner) for c, s in keys]
    return dict(zip(keys, fit_jointly(data.table, data.spec, data.split_ids, models), strict=True))


def cross_fit_both(data: TrainingSet, configs: Sequence[ModelConfig]) -> tuple[Fits, Fits]:
    """Outer and inner models in the same passes over the data."""
    keys = [(c, s) for c in range(len(configs)) for s in data.split_ids]
    models = [JointModel(configs[c], s, inner) for inner in (False, True) for c, s in keys]
    fitted = fit_jointly(data.table, data.spec, data.split_ids, models)
    return dict(zip(keys, fitted[: len(keys)], strict=True)), dict(zip(keys, fitted[len(keys) :], strict=True))


def score_test(data: TrainingSet, fits: Fits) -> DataFrame:
    """Scores of every model on the test side of its split."""
    return score_fits(data.test_rows(), fit_table(data.table.sparkSession, fits), data.spec)


def score_inner(data: TrainingSet, fits: Fits) -> DataFrame:
    """Scores of inner models on the inner validation side of their split's train rows."""
    return score_fits(data.inner_rows(), fit_table(data.table.sparkSession, fits), data.spec)


def model_metrics(scored: DataFrame, thresholds: DataFrame, data: TrainingSet, label_col: str = "label") -> DataFrame:
    """One row per (config, split): areas under the curves, confusion counts at 0.5 and at ``best_t``.

    Count columns at the best threshold carry the prefix ``best_``.
    """
    # One threshold per model.
    best = F.broadcast(thresholds.select(*MODEL_KEYS, F.col("threshold").alias("best_t")))
    decided = scored.join(best, MODEL_KEYS).withColumns(
        {"_half": decision_at("score", 0.5), "_best": decision_at("score", F.col("best_t"))}
    )
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    sums = [
        F.expr(f"CAST(sum(CASE WHEN `{label_col}` = {y} AND {column} = {p} THEN weight ELSE 0 END) AS BIGINT)").alias(prefix + name)
        for prefix, column in (("", "_half"), ("best_", "_best"))
        for name, (y, p) in cells.items()
    ]
    counts = decided.groupBy(*MODEL_KEYS, "best_t").agg(*sums)
    points = curve_points(score_counts(scored, MODEL_KEYS, "score", label_col, "weight"), MODEL_KEYS)
    areas = curve_areas(points, MODEL_KEYS).select(*MODEL_KEYS, "roc_auc", "pr_auc")
    total = data.table.agg(F.sum("weight")).scalar()
    return counts.join(areas, MODEL_KEYS).withColumns({"n_all": total, "split_mode": F.lit(data.split_mode)})


def counts_at(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Confusion counts of :func:`model_metrics` under their plain names (``best_`` for the best threshold)."""
    kept = [c for c in metrics.columns if c.removeprefix("best_") not in COUNTS]
    return metrics.select(*kept, *[F.col(prefix + c).alias(c) for c in COUNTS])


def result_table(metrics: DataFrame, prefix: str = "") -> DataFrame:
    """Result rows per (config, split) as a cross-validation reports them."""
    n_test, n_pos = F.expr("tn + fp + fn + tp"), F.expr("fn + tp")
    named = [c for c in ("C", "l1_ratio", "class_weight") if c in metrics.columns]
    return with_binary_metrics(counts_at(metrics, prefix)).select(
        *MODEL_KEYS,
        *named,
        "split_mode",
        n_test.alias("n_test"),
        (n_test / F.col("n_all")).alias("part_test"),
        (n_pos / n_test).alias("pos_rate"),
        "best_t",
        "roc_auc",
        "pr_auc",
        "precision",
        "recall",
        "f1",
        "f2",
        *[c for c in ("converged", "passes") if c in metrics.columns],
    )


@dataclass(frozen=True)
class Validation:
    """Tables keyed by ``(config_id, split_id)`` and the fitted models.

    ``metrics`` holds the counts; ``results`` are the metrics at 0.5 and ``best_t_results`` those at
    the best threshold.
    """

    metrics: DataFrame
    thresholds: DataFrame
    fits: Fits

    @property
    def results(self) -> DataFrame:
        return result_table(self.metrics)

    @property
    def best_t_results(self) -> DataFrame:
        return result_table(self.metrics, "best_")


def validate(data: TrainingSet, configs: Sequence[ModelConfig], metric: str = "f2") -> Validation:
    """Fit every configuration on every split and evaluate it.

    The threshold comes from an inner model that never saw the inner validation side; the tested
    model is fitted on the whole train side.  The metrics table (one row per model) is written once.
    """
    spark = data.table.sparkSession
    fits, inner = cross_fit_both(data, configs)
    sweep = threshold_sweep(score_inner(data, inner), MODEL_KEYS, weight_col="weight")
    best = best_threshold(sweep, MODEL_KEYS, metric)
    named = spark.createDataFrame(
        [(i, float(c.C), float(c.l1_ratio), str(c.class_weight)) for i, c in enumerate(configs)],
        "config_id int, C double, l1_ratio double, class_weight string",
    )
    states = spark.createDataFrame(
        [(*k, m.converged, m.passes) for k, m in fits.items()], "config_id int, split_id int, converged boolean, passes int"
    )
    # One row per configuration, and one per model.
    metrics = model_metrics(score_test(data, fits), best, data).join(F.broadcast(named), "config_id")
    metrics = metrics.join(F.broadcast(states), MODEL_KEYS)
    return Validation(cut_lineage(metrics), sweep, fits)
