"""Logistic regressions of all folds by iteratively reweighted least squares in the JVM.

For a few numeric features every Newton step needs only sums of products: with six features and a constant 28 for the
curvature and seven for the slope.  They are native aggregates grouped by fold, so one job serves all folds and rows never leave the JVM.  The
driver solves a system of seven unknowns per fold.  Coefficients come to the rows as a table of one row per fold, which
keeps the generated code the same from step to step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .features import FeatureSpec, Preprocessor
from .models import FittedModel, ModelConfig

#: Predicted gain (relative to the loss) below which a step is taken untested: the next one would gain its square.
TOLERANCE = 1e-9


def _scales(table: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (1 where 0) of the features, which only keep the sums well conditioned."""
    row = table.agg(*[F.avg(F.col(c).cast("double")) for c in features], *[F.stddev_pop(F.col(c).cast("double")) for c in features]).first()
    values = np.array([0.0 if v is None else v for v in row])
    means, stds = values[: len(features)], values[len(features) :]
    return means, np.where(stds > 0, stds, 1.0)


def fit_folds(table: DataFrame, features: Sequence[str], n_folds: int, config: ModelConfig = ModelConfig(penalise_intercept=False)) -> dict[int, FittedModel]:
    """One model per fold ``1..n_folds``, fitted on the rows (``features``, ``label``, ``weight``, ``fold``) of all other folds.

    Minimises ``C * sum of weighted log losses + half the squared slopes``, features as they are, with a free intercept; L2 without class
    weights only.  A step that does not lower the loss is halved.  Raises if a fold has not converged within ``max_iter`` steps.
    """
    if config.l1_ratio or config.class_weight or config.penalise_intercept:
        raise ValueError("folds are fitted with an L2 penalty on the slopes and without class weights")
    means, stds = _scales(table, features)
    width = len(features) + 1
    names = [f"_z{i}" for i in range(width)]
    scaled = [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, means, stds)]
    ids = F.array(*[F.lit(f) for f in range(1, n_folds + 1)])
    rows = table.select(F.explode(F.array_remove(ids, F.col("fold").cast("int"))).alias("_fold"), F.col("label").cast("double").alias("_y"), F.col("weight").cast("double").alias("_w"), *[c.alias(n) for c, n in zip([*scaled, F.lit(1.0)], names)])
    margin = sum((F.col(f"_b{i}") * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")))
    loss = F.greatest("_m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_m"))) - F.col("_y") * F.col("_m")
    upper = np.triu_indices(width)
    sums = [F.sum(F.col("_w") * loss).alias("_loss")]
    sums += [F.sum(F.col("_pull") * F.col(n)).alias(f"_g{i}") for i, n in enumerate(names)]
    sums += [F.sum(F.col("_bend") * F.col(names[i]) * F.col(names[j])).alias(f"_h{k}") for k, (i, j) in enumerate(zip(*upper))]
    columns = "_fold int, " + ", ".join(f"_b{i} double" for i in range(width))

    ridge = np.append(1.0 / stds**2, 0.0)
    beta, best, best_value = np.zeros((n_folds, width)), np.zeros((n_folds, width)), np.full(n_folds, np.inf)
    step, passes, done = np.zeros((n_folds, width)), np.zeros(n_folds, int), np.zeros(n_folds, bool)
    while not done.all():
        if passes.max() >= config.max_iter:
            raise ValueError(f"folds {(np.flatnonzero(~done) + 1).tolist()} have not converged within {config.max_iter} steps")
        active = np.flatnonzero(~done)
        now = table.sparkSession.createDataFrame([(int(f) + 1, *map(float, beta[f])) for f in active], columns)
        placed = rows.join(F.broadcast(now), "_fold").withColumn("_m", margin)
        found = placed.withColumns({"_pull": F.col("_w") * (p - F.col("_y")), "_bend": F.col("_w") * p * (1.0 - p)}).groupBy("_fold").agg(*sums).collect()
        seen = {r["_fold"] - 1: np.array(r[1:]) for r in found}
        passes[active] += 1
        for f in active:
            got = seen.get(f, np.zeros(1 + width + len(upper[0])))  # a fold that holds every row has no train side
            value = config.C * got[0] + 0.5 * (ridge * beta[f] ** 2).sum()
            if value > best_value[f] + 1e-10 * (1.0 + abs(value)):
                step[f] *= 0.5
            else:
                best[f], best_value[f] = beta[f], value
                slope = config.C * got[1 : 1 + width] + ridge * beta[f]
                curve = np.zeros((width, width))
                curve[upper] = config.C * got[1 + width :]
                curve = curve + np.triu(curve, 1).T + np.diag(ridge)
                step[f] = -np.linalg.lstsq(curve, slope, rcond=None)[0]
                done[f] = abs(slope @ step[f]) <= TOLERANCE * (1.0 + abs(value))
            beta[f] = best[f] + step[f]
            done[f] |= np.abs(step[f]).max() < 1e-14
            if done[f]:
                best[f] = beta[f]
    spec = FeatureSpec(tuple(features), ())
    plain = Preprocessor(spec, dict.fromkeys(features, 0.0), dict.fromkeys(features, 1.0))
    return {
        f + 1: FittedModel(plain, config, float(b[-1] - b[:-1] @ (means / stds)), tuple((b[:-1] / stds).tolist()), passes=int(n))
        for f, (b, n) in enumerate(zip(beta, passes))
    }
