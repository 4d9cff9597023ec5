"""Many logistic regressions fitted together.

Cross-validation and grid search fit the same rows again and again: 16 configurations on 30 splits
with an inner model each are 960 fits.  Fitted one by one, each of their iterations is a Spark job
over the data.  Here every iteration is one job for all models: tasks compute each model's loss,
gradient and Hessian over their rows (a matrix product per batch), Spark sums them per model, and
only those sums reach the driver, where each model takes a Newton step in a handful of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .features import MOST_LEVELS, FeatureSpec, Preprocessor, check_features
from .models import FittedModel, ModelConfig

TOLERANCE = 1e-12
#: Inner proximal steps per pass.  A model whose inner steps have not settled is never taken as done: its
#: next pass over the data goes on from where they got to.
PROXIMAL_STEPS = 3000


@dataclass(frozen=True)
class JointModel:
    """One model to fit: its configuration, its split, and whether inner validation rows are left out."""

    config: ModelConfig
    split_id: int
    inner: bool = False


@dataclass(frozen=True)
class Design:
    """Columns of the shared design: centred numeric features, a 0/1 column per category level, a constant."""

    spec: FeatureSpec
    centres: tuple[float, ...]
    levels: tuple[tuple[str, str], ...]

    @property
    def width(self) -> int:
        return len(self.centres) + len(self.levels) + 1

    @staticmethod
    def of(table: DataFrame, spec: FeatureSpec) -> "Design":
        check_features(table, spec, MOST_LEVELS)
        row = table.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(c).alias(f"_mean_{c}") for c in spec.numeric],
            *[F.sort_array(F.collect_set(c)).alias(f"_levels_{c}") for c in spec.categorical],
        ).first()
        levels = tuple((c, level) for c in spec.categorical for level in row[f"_levels_{c}"])
        return Design(spec, tuple(float(row[f"_mean_{c}"]) for c in spec.numeric), levels)

    def rows(self, table: DataFrame, split_ids: Sequence[int]) -> DataFrame:
        """``x`` (design row), ``y``, ``w``, ``train`` (0/1 per split) and ``inner`` (weight left by the inner draw, per split)."""
        numeric = [F.col(c).cast("double") - F.lit(m) for c, m in zip(self.spec.numeric, self.centres, strict=True)]
        dummies = [F.coalesce(F.col(c) == level, F.lit(False)).cast("double") for c, level in self.levels]
        in_train = [(~F.array_contains("test_in", s)).cast("double") for s in split_ids]
        left = [(F.col("weight") - F.coalesce(F.get("held", i), F.lit(0))).cast("double") for i in range(len(split_ids))]
        return table.select(
            F.array(*numeric, *dummies, F.lit(1.0)).alias("x"),
            F.col("label").cast("double").alias("y"),
            F.col("weight").cast("double").alias("w"),
            F.array(*in_train).alias("train"),
            F.array(*left).alias("inner"),
        )


def _sums_per_model(rows: DataFrame, width: int, batch_sums) -> np.ndarray:
    """Run ``batch_sums(x, y, w, train, inner) -> (models, width)`` over all rows and add the results up."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = batch_sums(
                    np.stack(batch["x"].to_numpy()),
                    batch["y"].to_numpy(),
                    batch["w"].to_numpy(),
                    np.stack(batch["train"].to_numpy()),
                    np.stack(batch["inner"].to_numpy()),
                )
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"id": np.arange(len(total), dtype="int32"), "v": list(total)})

    parts = rows.mapInPandas(partial, "id int, v array<double>")
    summed = parts.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    out = np.zeros((len(summed), width))
    for row in summed:
        out[row["id"]] = row["v"]
    return out


def _side_weights(w, train, inner, split_index, is_inner):
    """Row weights per model side: in the train side of the split, and outside its inner validation."""
    return train[:, split_index] * np.where(is_inner[None, :], inner[:, split_index], w[:, None])


def _moments(rows: DataFrame, n_numeric: int, width: int, split_index: np.ndarray, is_inner: np.ndarray) -> np.ndarray:
    """Per side: weight of each class, sums of the design, squared sums of the numeric features."""

    def sums(x, y, w, train, inner):
        side = _side_weights(w, train, inner, split_index, is_inner)
        per_class = np.stack([side[y == 0].sum(axis=0), side[y == 1].sum(axis=0)], axis=1)
        return np.hstack([per_class, side.T @ x, side.T @ x[:, :n_numeric] ** 2])

    return _sums_per_model(rows, 2 + width + n_numeric, sums)


def _loss_terms(
    rows: DataFrame, beta: np.ndarray, split_index: np.ndarray, is_inner: np.ndarray, class_factor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the weighted log loss of every model, in the shared design."""
    width = beta.shape[1]
    upper = np.triu_indices(width)

    def sums(x, y, w, train, inner):
        weight = _side_weights(w, train, inner, split_index, is_inner) * class_factor[:, y.astype(int)].T
        margin = x @ beta.T
        prob = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        loss = weight * (np.logaddexp(0.0, margin) - y[:, None] * margin)
        gradient = (weight * (prob - y[:, None])).T @ x
        hessian = (weight * prob * (1.0 - prob)).T @ (x[:, upper[0]] * x[:, upper[1]])
        return np.hstack([loss.sum(axis=0)[:, None], gradient, hessian])

    out = _sums_per_model(rows, 1 + width + len(upper[0]), sums)
    hessian = np.zeros((len(out), width, width))
    hessian[:, upper[0], upper[1]] = out[:, 1 + width :]
    hessian[:, upper[1], upper[0]] = out[:, 1 + width :]
    return out[:, 0], out[:, 1 : 1 + width], hessian


def _penalised_step(beta, gradient, hessian, l1, l2, free):
    """Minimiser of the quadratic model plus penalty, per model, and whether it has settled."""
    step, settled = np.zeros_like(beta), np.ones(len(beta), dtype=bool)
    smooth = gradient + l2 * beta
    curved = hessian + np.einsum("mi,ij->mij", l2, np.eye(beta.shape[1]))
    fixed = ~free
    smooth = np.where(fixed, 0.0, smooth)
    curved = np.where(fixed[:, :, None] | fixed[:, None, :], 0.0, curved)
    diagonal = np.einsum("mii->mi", curved)
    diagonal[:] = np.where(diagonal > 0, diagonal, 1.0)
    plain = ~(l1 > 0).any(axis=1)
    if plain.any():
        step[plain] = -np.linalg.solve(curved[plain], smooth[plain][:, :, None])[:, :, 0]
    rest = np.flatnonzero(~plain)
    if len(rest):
        step[rest], settled[rest] = _accelerated(beta[rest], smooth[rest], curved[rest], l1[rest], free[rest])
    return step, settled


def _accelerated(beta, smooth, curved, l1, free):
    """Accelerated proximal gradient on ``smooth @ d + d @ curved @ d / 2 + sum(l1 * |beta + d|)``.

    Works on all models at once; a model's momentum restarts when it points uphill.  An early stop
    is fine: the next pass over the data starts from where this one got to.
    """
    rate = 1.0 / np.linalg.eigvalsh(curved)[:, -1:]
    step, ahead, momentum = np.zeros_like(beta), np.zeros_like(beta), np.ones((len(beta), 1))
    for _ in range(PROXIMAL_STEPS):
        slope = smooth + (curved @ ahead[:, :, None])[:, :, 0]
        target = beta + ahead - rate * slope
        shrunk = np.sign(target) * np.maximum(np.abs(target) - rate * l1, 0.0)
        new = np.where(free, shrunk - beta, 0.0)
        moved = new - step
        uphill = ((ahead - new) * moved).sum(axis=1, keepdims=True) > 0
        momentum = np.where(uphill, 1.0, momentum)
        following = (1.0 + np.sqrt(1.0 + 4.0 * momentum**2)) / 2.0
        ahead = new + (momentum - 1.0) / following * moved
        step, momentum = new, following
        if np.max(np.abs(moved)) < 1e-11:
            break
    return step, np.abs(moved).max(axis=1) < 1e-8


def fit_jointly(
    table: DataFrame,
    spec: FeatureSpec,
    split_ids: Sequence[int],
    models: Sequence[JointModel],
    scale: bool = True,
    strict: bool = True,
) -> list[FittedModel]:
    """Fit all models over ``table`` (features, ``label``, ``weight``, ``held``, ``test_in``).

    A model takes at most ``max_iter`` passes of its configuration.  One that has not converged by then raises an
    error; with ``strict=False`` it is returned with ``converged`` false.

    Each model minimises ``C * sum of weighted log losses + penalty`` on its own train side, with
    its own scaling and categories.  ``scale=False`` uses the features as they are.
    """
    design = Design.of(table, spec)
    rows = design.rows(table, split_ids)
    width, n_numeric, const = design.width, len(spec.numeric), design.width - 1
    position = {s: i for i, s in enumerate(split_ids)}
    split_index = np.array([position[m.split_id] for m in models])
    is_inner = np.array([m.inner for m in models])

    # One pass for the statistics of every distinct train side.
    sides, side_of = np.unique(np.stack([split_index, is_inner.astype(int)], axis=1), axis=0, return_inverse=True)
    moments = _moments(rows, n_numeric, width, sides[:, 0], sides[:, 1].astype(bool))[side_of.reshape(-1)]
    per_class, sums, squares = moments[:, :2], moments[:, 2 : 2 + width], moments[:, 2 + width :]
    total = per_class.sum(axis=1)
    centred = sums[:, :n_numeric] / total[:, None]
    spread = np.sqrt(np.maximum(squares / total[:, None] - centred**2, 0.0))
    spread[spread < 1e-12] = 0.0
    means = np.array(design.centres)[None, :] + centred
    if not scale:
        means, spread = np.zeros_like(means), np.ones_like(spread)
    present = sums[:, n_numeric:const] > 0
    free = np.ones((len(models), width), dtype=bool)
    categories: list[dict[str, list[str]]] = []
    for m in range(len(models)):
        found: dict[str, list[str]] = {c: [] for c in spec.categorical}
        for i, (c, level) in enumerate(design.levels):
            if present[m, i]:
                found[c].append(level)
            free[m, n_numeric + i] = present[m, i] and len(found[c]) > 1
        categories.append(found)

    # Scaled features are an affine map of the design: z = to_scaled @ x.
    to_scaled = np.tile(np.eye(width), (len(models), 1, 1))
    divisor = np.where(spread > 0, spread, 1.0)
    for j in range(n_numeric):
        to_scaled[:, j, j] = 1.0 / divisor[:, j]
        to_scaled[:, j, const] = (design.centres[j] - means[:, j]) / divisor[:, j]

    strength = np.array([m.config.C for m in models])
    ratio = np.array([m.config.l1_ratio for m in models])
    penalised = np.ones((len(models), width))
    penalised[:, const] = [float(m.config.penalise_intercept) for m in models]
    l1, l2 = penalised * ratio[:, None], penalised * (1.0 - ratio)[:, None]
    factor = np.ones((len(models), 2))
    for i, m in enumerate(models):
        if m.config.class_weight == "balanced":
            factor[i] = total[i] / (2.0 * np.maximum(per_class[i], 1e-300))
        elif m.config.class_weight is not None:
            raise ValueError(f"unknown class weight: {m.config.class_weight}")

    beta = np.zeros((len(models), width))
    best, best_value = beta.copy(), np.full(len(models), np.inf)
    step = np.zeros_like(beta)
    active = np.arange(len(models))
    allowed = np.array([m.config.max_iter for m in models])
    converged, passes = np.zeros(len(models), dtype=bool), np.zeros(len(models), dtype=int)
    while len(active := active[passes[active] < allowed[active]]):
        a = active
        passes[a] += 1
        in_design = np.einsum("mi,mij->mj", beta[a], to_scaled[a])
        loss, gradient, hessian = _loss_terms(rows, in_design, split_index[a], is_inner[a], factor[a])
        penalty = (l1[a] * np.abs(beta[a]) + 0.5 * l2[a] * beta[a] ** 2).sum(axis=1)
        value = strength[a] * loss + penalty
        worse = value > best_value[a] + 1e-10 * (1.0 + np.abs(value))
        # A step that did not help is halved; its model waits for the next pass.
        step[a[worse]] *= 0.5
        good = a[~worse]
        best[good], best_value[good] = beta[good], value[~worse]
        scaled_gradient = strength[good, None] * np.einsum("mij,mj->mi", to_scaled[good], gradient[~worse])
        scaled_hessian = strength[good, None, None] * (
            to_scaled[good] @ hessian[~worse] @ to_scaled[good].transpose(0, 2, 1)
        )
        step[good], settled = _penalised_step(best[good], scaled_gradient, scaled_hessian, l1[good], l2[good], free[good])
        moved = best + step
        change = (scaled_gradient * step[good]).sum(axis=1) + (
            l1[good] * (np.abs(moved[good]) - np.abs(best[good])) + 0.5 * l2[good] * (moved[good] ** 2 - best[good] ** 2)
        ).sum(axis=1)
        done = np.zeros(len(models), dtype=bool)
        done[good] = settled & (np.abs(change) <= TOLERANCE * (1.0 + np.abs(best_value[good])))
        done[a] |= np.abs(step[a]).max(axis=1) < 1e-14
        beta = moved
        best[done] = moved[done]  # the last step, too small to be tested, still sharpens the slopes
        converged |= done
        active = a[~done[a]]
    if strict and not converged.all():
        left = [f"{m.config.describe()} on split {m.split_id}" for m, ok in zip(models, converged) if not ok]
        raise ValueError(f"{len(left)} models have not converged within max_iter: {'; '.join(left[:5])}")

    fitted = []
    for i, m in enumerate(models):
        prep = Preprocessor(
            spec,
            dict(zip(spec.numeric, means[i].tolist(), strict=True)),
            dict(zip(spec.numeric, spread[i].tolist(), strict=True)),
            categories[i],
        )
        kept = [j for j in range(const) if j < n_numeric or free[i, j]]
        weights = tuple(float(best[i, j]) for j in kept)
        fitted.append(
            FittedModel(prep, m.config, float(best[i, const]), weights, converged=bool(converged[i]), passes=int(passes[i]))
        )
    return fitted
