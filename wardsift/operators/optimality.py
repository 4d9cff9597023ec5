"""Optimality certificates of fitted models.

A fit is proved by its coefficients and the rows alone, whatever solver found them: at the minimum of
``C * sum of weighted log losses + l1 * |b| + l2 / 2 * b ** 2`` every coefficient meets its subgradient condition.  The slope of
the loss along a coefficient ``b`` must be ``-(l2 * b + l1 * sign(b))``, and within ``l1`` of zero where ``b`` is zero.  Slopes
are sums over the train rows, so one aggregation certifies every model of a search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .features import preprocessing_stats
from .models import ModelConfig, coefficient_table, fit_table, score_fits
from .validation import MODEL_KEYS, Fits, TrainingSet

INTERCEPT = "intercept"
TOLERANCE = 1e-5


def _config_table(data: TrainingSet, configs: Sequence[ModelConfig]) -> DataFrame:
    """One row per configuration."""
    rows = [(i, float(c.C), float(c.l1_ratio), c.class_weight == "balanced", bool(c.penalise_intercept)) for i, c in enumerate(configs)]
    return data.table.sparkSession.createDataFrame(rows, "config_id int, _c double, _l1 double, _balanced boolean, _penalised boolean")


def _train_losses(data: TrainingSet, fits: Fits, configs: Sequence[ModelConfig]) -> DataFrame:
    """Train patterns of every split with every model's ``score``, and the ``_weight`` they have in its loss."""
    scored = score_fits(data.train_rows(), fit_table(data.table.sparkSession, fits), data.spec)
    counts = data.train_rows().groupBy("split_id").agg(
        F.sum("weight").alias("_n"), F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0)).alias("_n1")
    )
    # One row per split, and one per configuration.
    rows = scored.join(F.broadcast(counts), "split_id").join(F.broadcast(_config_table(data, configs)), "config_id")
    own = F.when(F.col("label") == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1"))
    factor = F.when(F.col("_balanced"), F.col("_n") / (2.0 * own)).otherwise(1.0)
    return rows.withColumn("_weight", F.col("_c") * factor * F.col("weight"))


def _features(data: TrainingSet, rows: DataFrame) -> DataFrame:
    """``rows`` once per model feature that is not zero, with its ``feature`` name and scaled ``_value``."""
    spec = data.spec
    stats = preprocessing_stats(data.train_rows(), spec, ["split_id"])
    # One row of means and deviations per split.
    joined = rows.join(F.broadcast(stats.select("split_id", *[f"_{k}_{c}" for k in ("mean", "std") for c in spec.numeric])), "split_id")

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("feature"), value.alias("_value"))

    numeric = [
        entry(F.lit(c), (F.col(c).cast("double") - F.col(f"_mean_{c}")) / F.when(F.col(f"_std_{c}") < 1e-12, 1.0).otherwise(F.col(f"_std_{c}")))
        for c in spec.numeric
    ]
    levels = [entry(F.concat(F.lit(f"{c}_"), F.col(c)), F.lit(1.0)) for c in spec.categorical]
    return joined.select("*", F.inline(F.array(*numeric, *levels, entry(F.lit(INTERCEPT), F.lit(1.0)))))


def certify(data: TrainingSet, fits: Fits, configs: Sequence[ModelConfig], tolerance: float = TOLERANCE) -> DataFrame:
    """``(config_id, split_id, feature, coef, slope, residual, optimal)`` for every coefficient, the intercept included.

    ``residual`` is how far the coefficient is from its condition; ``optimal`` allows ``tolerance`` times the absolute terms of the
    slope.  Slopes and residuals are the same for all optimal coefficients, also where features that depend on each
    other leave more than one choice of them.
    """
    spark = data.table.sparkSession
    pull = F.col("_weight") * (F.col("score") - F.col("label")) * F.col("_value")
    slopes = _features(data, _train_losses(data, fits, configs)).groupBy(*MODEL_KEYS, "feature").agg(
        F.sum(pull).alias("slope"), F.sum(F.abs(pull)).alias("_size")
    )
    intercepts = spark.createDataFrame([(*k, INTERCEPT, m.intercept) for k, m in fits.items()], "config_id int, split_id int, feature string, coef double")
    coefs = coefficient_table(spark, fits).select(*MODEL_KEYS, "feature", "coef").union(intercepts)
    # A feature that is zero on the whole train side has no terms; a few rows per model.
    joined = coefs.join(slopes, [*MODEL_KEYS, "feature"], "left").fillna(0.0, ["slope", "_size"]).join(F.broadcast(_config_table(data, configs)), "config_id")
    penalised = (F.col("feature") != INTERCEPT) | F.col("_penalised")
    l1, l2 = F.when(penalised, F.col("_l1")).otherwise(0.0), F.when(penalised, 1.0 - F.col("_l1")).otherwise(0.0)
    smooth = F.col("slope") + l2 * F.col("coef")
    residual = F.when(F.col("coef") == 0, F.greatest(F.abs(smooth) - l1, F.lit(0.0))).otherwise(F.abs(smooth + l1 * F.signum("coef")))
    return joined.withColumn("residual", residual).select(
        *MODEL_KEYS, "feature", "coef", "slope", "residual", (F.col("residual") <= tolerance * (1.0 + F.col("_size"))).alias("optimal")
    )


def objectives(data: TrainingSet, fits: Fits, configs: Sequence[ModelConfig]) -> DataFrame:
    """``(config_id, split_id, loss, penalty, objective)``: what every model minimises, at its coefficients."""
    score = F.col("score")
    right = F.when(F.col("label") == 1, score).otherwise(1.0 - score)
    losses = _train_losses(data, fits, configs).groupBy(*MODEL_KEYS).agg(F.sum(-F.col("_weight") * F.log(right)).alias("loss"))
    rows = [
        (*k, sum(configs[k[0]].l1_ratio * abs(b) + (1 - configs[k[0]].l1_ratio) / 2 * b * b for b in (*m.coefficients, *([m.intercept] if m.config.penalise_intercept else []))))
        for k, m in fits.items()
    ]
    penalties = data.table.sparkSession.createDataFrame(rows, "config_id int, split_id int, penalty double")
    return losses.join(penalties, MODEL_KEYS).withColumn("objective", F.col("loss") + F.col("penalty"))
