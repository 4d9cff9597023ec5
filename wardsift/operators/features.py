"""Feature preparation: compressed patterns, scaling, one-hot, class weights.

Signals take few distinct values, so a training table is first compressed to weighted patterns
(distinct feature tuples with their row count).  Statistics, fits and metrics on patterns equal
those on rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES

CONSTANT = "_const"
MOST_LEVELS = 1000


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric and categorical model features."""

    numeric: Sequence[str] = NUMERIC_FEATURES
    categorical: Sequence[str] = CATEGORICAL_FEATURES

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


@dataclass(frozen=True)
class Preprocessor:
    """Fitted scaling and one-hot encoding.

    Numeric features are centred and divided by the population standard deviation (1 where it is
    0); each category but the alphabetically first becomes a 0/1 column; unseen values give zeros.
    """

    spec: FeatureSpec
    means: dict[str, float]
    stds: dict[str, float]
    categories: dict[str, list[str]] = field(default_factory=dict)

    @property
    def levels(self) -> list[tuple[str, str]]:
        return [(c, level) for c in self.spec.categorical for level in self.categories[c][1:]]

    @property
    def feature_names(self) -> list[str]:
        return [*self.spec.numeric, *[f"{c}_{level}" for c, level in self.levels]]

    def encoded_columns(self) -> list[Column]:
        """One expression per model feature."""
        scaled = [
            (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.stds[c] or 1.0) for c in self.spec.numeric
        ]
        dummies = [F.coalesce(F.col(c) == level, F.lit(False)).cast("double") for c, level in self.levels]
        return [*scaled, *dummies]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add one column per model feature."""
        return df.withColumns(dict(zip(self.feature_names, self.encoded_columns(), strict=True)))

    def stages(self) -> list[Transformer]:
        """The same preparation as ML stages, for saving a whole pipeline."""

        def quoted(text: str) -> str:
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

        numeric = [
            f"(CAST(`{c}` AS DOUBLE) - ({self.means[c]!r}D)) / {self.stds[c] or 1.0!r}D AS `_x{i}`"
            for i, c in enumerate(self.spec.numeric)
        ]
        offset = len(numeric)
        dummies = [
            f"CAST(COALESCE(`{c}` = {quoted(level)}, false) AS DOUBLE) AS `_x{offset + i}`"
            for i, (c, level) in enumerate(self.levels)
        ]
        names = [f"_x{i}" for i in range(len(numeric) + len(dummies))]
        select = ", ".join([*numeric, *dummies, f"1.0D AS `{CONSTANT}`"])
        return [
            SQLTransformer(statement=f"SELECT *, {select} FROM __THIS__"),
            VectorAssembler(inputCols=[*names, CONSTANT], outputCol="features"),
        ]


def compress_patterns(
    df: DataFrame, spec: FeatureSpec = FeatureSpec(), label_col: str = "label", keep: Sequence[str] = ()
) -> DataFrame:
    """Distinct (features, label, kept keys) with ``weight`` = number of rows."""
    return df.groupBy(*spec.columns, label_col, *keep).agg(F.count(F.lit(1)).alias("weight"))


def check_features(table: DataFrame, spec: FeatureSpec, most_levels: int) -> None:
    """Reject null numeric features and category columns with too many levels, naming the columns.

    Levels become model columns, and the tables of a fit grow with their square; counts come first, so that an
    unsuitable column is never collected.
    """
    row = table.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in spec.numeric],
        *[F.approx_count_distinct(c).alias(f"_levels_{c}") for c in spec.categorical],
        F.count(F.lit(1)).alias("_n"),
    ).first()
    nulls = {c: row[f"_null_{c}"] for c in spec.numeric if row[f"_null_{c}"]}
    if nulls:
        raise ValueError(f"numeric features with nulls (rows): {nulls}")
    wide = {c: row[f"_levels_{c}"] for c in spec.categorical if row[f"_levels_{c}"] > most_levels}
    if wide:
        raise ValueError(f"category columns with more than {most_levels} levels (about): {wide}")


def preprocessing_stats(train: DataFrame, spec: FeatureSpec, by: Sequence[str] = (), weight_col: str = "weight") -> DataFrame:
    """Weighted mean, population deviation and sorted categories per group, in two aggregations.

    Deviations use the mean of a first pass, which keeps them exact for large means.
    """
    w = F.col(weight_col).cast("double")
    means = train.groupBy(*by).agg(
        *[(F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"_mean_{c}") for c in spec.numeric],
        *[F.sort_array(F.collect_set(F.col(c))).alias(f"_levels_{c}") for c in spec.categorical],
    )
    if by:
        centred = train.join(means, list(by))
    else:
        one = means.select(F.struct(*means.columns)).scalar()
        centred = train.withColumns({c: one[c] for c in means.columns})
    spread = [
        F.sqrt(
            F.sum(w * F.pow(F.col(c) - F.col(f"_mean_{c}"), F.lit(2.0))) / F.sum(F.when(F.col(c).isNotNull(), w))
        ).alias(f"_std_{c}")
        for c in spec.numeric
    ]
    kept = [F.first(c).alias(c) for c in means.columns if c not in by]
    return centred.groupBy(*by).agg(*spread, *kept)


def fit_preprocessors(
    train: DataFrame, spec: FeatureSpec = FeatureSpec(), by: str | None = None, weight_col: str = "weight"
) -> dict[object, Preprocessor]:
    """Fitted preprocessors per value of ``by`` (``None`` without), all from one job.

    What comes to the driver is a mean, a deviation and the categories per feature and split.
    """
    check_features(train, spec, MOST_LEVELS)
    rows = preprocessing_stats(train, spec, [by] if by else [], weight_col).collect()
    return {
        (row[by] if by else None): Preprocessor(
            spec,
            {c: row[f"_mean_{c}"] for c in spec.numeric},
            {c: row[f"_std_{c}"] for c in spec.numeric},
            {c: list(row[f"_levels_{c}"]) for c in spec.categorical},
        )
        for row in rows
    }


def fit_preprocessor(train: DataFrame, spec: FeatureSpec = FeatureSpec(), weight_col: str = "weight") -> Preprocessor:
    return fit_preprocessors(train, spec, None, weight_col)[None]


def class_weights(df: DataFrame, label_col: str = "label", weight_col: str | None = None) -> DataFrame:
    """Balanced class weights ``n / (2 * n_class)``: one row per class."""
    count = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    counts = df.groupBy(label_col).agg(count.cast("bigint").alias("n_class"))
    total = counts.agg(F.sum("n_class")).scalar()
    return counts.withColumn("class_weight", total / (F.lit(2.0) * F.col("n_class")))
