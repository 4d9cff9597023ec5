"""Logistic regression over weighted patterns."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .features import CONSTANT, FeatureSpec, Preprocessor


@dataclass(frozen=True)
class ModelConfig:
    """Inverse penalty strength, L2 (0) or L1 (1), and class weighting (None or ``balanced``)."""

    C: float = 1.0
    l1_ratio: float = 0.0
    class_weight: str | None = None
    max_iter: int = 1000
    penalise_intercept: bool = True

    def describe(self) -> dict[str, Any]:
        return {"C": float(self.C), "l1_ratio": float(self.l1_ratio), "class_weight": str(self.class_weight)}


@dataclass(frozen=True)
class FittedModel:
    """Coefficients in the scaled feature space, with the preparation they belong to."""

    preprocessor: Preprocessor
    config: ModelConfig
    intercept: float
    coefficients: tuple[float, ...]
    model: LogisticRegressionModel | None = None
    converged: bool = True
    passes: int = 0

    def coefficient_rows(self) -> list[tuple[str, float]]:
        return list(zip(self.preprocessor.feature_names, self.coefficients, strict=True))

    def raw_form(self) -> tuple[float, list[float], dict[str, float]]:
        """Intercept, slopes of the numeric features and weights per ``column=value``, unscaled."""
        prep = self.preprocessor
        n = len(prep.spec.numeric)
        slopes = [w / (prep.stds[c] or 1.0) for w, c in zip(self.coefficients, prep.spec.numeric)]
        shift = sum(s * prep.means[c] for s, c in zip(slopes, prep.spec.numeric))
        levels = {f"{c}={level}": w for (c, level), w in zip(prep.levels, self.coefficients[n:])}
        return self.intercept - shift, slopes, levels

    def probability(self) -> Column:
        """Probability of class 1 as an expression over the raw features: the model's numbers are part of the plan, so scoring needs
        no function that the session would have to send to its tasks."""
        intercept, slopes, levels = self.raw_form()
        margin = F.lit(intercept)
        for slope, c in zip(slopes, self.preprocessor.spec.numeric, strict=True):
            margin = margin + F.lit(slope) * F.col(c).cast("double")
        for (c, level), weight in zip(self.preprocessor.levels, levels.values(), strict=True):
            margin = margin + F.when(F.col(c) == level, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def pipeline(self) -> PipelineModel:
        """Preparation and model as one savable pipeline (models of :func:`fit_logistic` only)."""
        if self.model is None:
            raise ValueError("fit with fit_logistic to save a pipeline")
        return PipelineModel([*self.preprocessor.stages(), self.model])


def fit_logistic(
    train: DataFrame,
    preprocessor: Preprocessor,
    config: ModelConfig = ModelConfig(),
    label_col: str = "label",
    weight_col: str = "weight",
) -> FittedModel:
    """Fit one model with MLlib.

    The objective is a summed, class-weighted log loss times C plus the penalty; MLlib averages
    the loss, so its penalty is ``1 / (C * total weight)``.  To penalise the intercept as well, the
    data are joined by their mirror image (all features negated, label flipped) with a constant
    feature and no free intercept; the mirror leaves the optimum unchanged.
    """
    sums = {r[label_col]: float(r["n"]) for r in train.groupBy(label_col).agg(F.sum(weight_col).alias("n")).collect()}
    total = sum(sums.values())
    factor: Column = F.lit(1.0)
    if config.class_weight == "balanced":
        factor = F.lit(None).cast("double")
        for label, n in sums.items():
            factor = F.when(F.col(label_col) == label, F.lit(total / (2.0 * n))).otherwise(factor)
        total = total * len(sums) / 2.0
    elif config.class_weight is not None:
        raise ValueError(f"unknown class weight: {config.class_weight}")

    encoded = preprocessor.encoded_columns()
    names = [f"_x{i}" for i in range(len(encoded))]
    table = train.select(
        F.col(label_col).cast("double").alias("label"),
        (F.col(weight_col) * factor).cast("double").alias("weight"),
        *[c.alias(n) for c, n in zip(encoded, names)],
        F.lit(1.0).alias(CONSTANT),
    )
    names.append(CONSTANT)
    if config.penalise_intercept:
        mirror = table.select((F.lit(1.0) - F.col("label")).alias("label"), "weight", *[(-F.col(n)).alias(n) for n in names])
        table = table.unionByName(mirror)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("label", "weight", "features")
    learner = LogisticRegression(
        maxIter=config.max_iter,
        regParam=1.0 / (config.C * total),
        elasticNetParam=float(config.l1_ratio),
        standardization=False,
        fitIntercept=not config.penalise_intercept,
        weightCol="weight",
        tol=1e-9,
    )
    model = learner.fit(vectors)
    passes, losses = model.summary.totalIterations, model.summary.objectiveHistory
    settled = len(losses) > 1 and abs(losses[-2] - losses[-1]) <= 1e-9 * max(abs(losses[-1]), 1e-300)
    if passes >= config.max_iter and not settled:
        raise ValueError(f"the fit has not converged within {config.max_iter} iterations")
    weights = [float(v) for v in model.coefficients]
    intercept = weights[-1] if config.penalise_intercept else float(model.intercept)
    return FittedModel(preprocessor, config, intercept, tuple(weights[:-1]), model, True, passes)


FIT_SCHEMA = T.StructType(
    [
        T.StructField("config_id", T.IntegerType()),
        T.StructField("split_id", T.IntegerType()),
        T.StructField("_intercept", T.DoubleType()),
        T.StructField("_slopes", T.ArrayType(T.DoubleType())),
        T.StructField("_levels", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def fit_table(spark: SparkSession, fits: dict[tuple[int, int], FittedModel]) -> DataFrame:
    """Fitted models as a table keyed by (config, split): a few numbers per model."""
    return spark.createDataFrame([(c, s, *m.raw_form()) for (c, s), m in fits.items()], FIT_SCHEMA)


def probability(spec: FeatureSpec) -> Column:
    """Probability of class 1 from the columns of :func:`fit_table` and the raw features."""
    margin = F.col("_intercept")
    for i, c in enumerate(spec.numeric):
        margin = margin + F.col("_slopes")[i] * F.col(c).cast("double")
    for c in spec.categorical:
        key = F.concat(F.lit(f"{c}="), F.col(c))
        margin = margin + F.coalesce(F.try_element_at(F.col("_levels"), key), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score_fits(rows: DataFrame, fits: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Score rows that carry ``split_id`` with every model of their split, in one join.

    The fits table has one small row per model (configs times splits), so it is broadcast.
    """
    joined = rows.join(F.broadcast(fits), "split_id")
    return joined.withColumn("score", probability(spec)).drop("_intercept", "_slopes", "_levels")


def coefficient_table(spark: SparkSession, fits: dict[tuple[int, int], FittedModel]) -> DataFrame:
    """``(config_id, split_id, feature, coef, converged, passes)``, largest coefficient first per model."""
    rows = [
        (config, split, feature, coef, model.converged, model.passes)
        for (config, split), model in sorted(fits.items())
        for feature, coef in sorted(model.coefficient_rows(), key=lambda fc: (-fc[1], fc[0]))
    ]
    return spark.createDataFrame(rows, "config_id int, split_id int, feature string, coef double, converged boolean, passes int")
