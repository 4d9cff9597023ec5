"""Summaries over small result tables: one row per split, or per configuration and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import lenient_double

# Columns and quantiles of the summaries.
CV_COLUMNS = (
    "n_test",
    "part_test",
    "pos_rate",
    "best_t",
    "roc_auc",
    "pr_auc",
    "precision",
    "recall",
    "f1",
    "f2",
)
CV_QUANTILES = (0.05, 0.10, 0.25, 0.75, 0.90, 0.95)
GRID_KEYS = ("config_id", "C", "l1_ratio", "class_weight")


def cv_summary(results: DataFrame, by: Sequence[str] = (), columns: Sequence[str] = CV_COLUMNS) -> DataFrame:
    """Per result column: count, mean, median, sample std, min, max, quantiles and IQR over splits.

    Values that are no numbers count as missing.  A group holds one row per split, so the built-in
    exact percentile sees a handful of values.
    """
    pairs = [F.struct(F.lit(c).alias("metric"), lenient_double(F.col(c)).alias("value")) for c in columns]
    long = results.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.metric", "p.value")
    quantiles = F.percentile("value", [0.5, *CV_QUANTILES])
    summary = long.groupBy(*by, "metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        quantiles.alias("_q"),
    )
    named = {"median": 0, **{f"q{round(q * 100)}": i + 1 for i, q in enumerate(CV_QUANTILES)}}
    return summary.withColumns({name: F.col("_q")[i] for name, i in named.items()}).select(
        *by, "metric", "count", "mean", "median", "std", "min", "max",
        *[f"q{round(q * 100)}" for q in CV_QUANTILES],
        (F.col("q75") - F.col("q25")).alias("IQR"),
    )


def defined_splits(results: DataFrame, by: Sequence[str] = (), column: str = "roc_auc") -> DataFrame:
    """How many splits have a defined value, of how many."""
    return results.groupBy(*by).agg(F.count(column).alias("n_defined"), F.count(F.lit(1)).alias("n_splits"))


def grid_summary(results: DataFrame, keys: Sequence[str] = GRID_KEYS) -> DataFrame:
    """Per configuration: mean, median and population std of the metrics over splits.

    F2 also gets minimum, q10 and q25; the best threshold gets q10 and q25.
    """

    def core(name: str) -> list[Column]:
        return [
            F.avg(name).alias(f"mean_{name}"),
            F.percentile(name, F.lit(0.5)).alias(f"median_{name}"),
            F.stddev_pop(name).alias(f"std_{name}"),
        ]

    def low(name: str) -> list[Column]:
        return [F.percentile(name, F.lit(q)).alias(f"q{round(q * 100)}_{name}") for q in (0.10, 0.25)]

    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits"),
        *core("f2"),
        F.min("f2").alias("min_f2"),
        *low("f2"),
        *core("pr_auc"),
        *core("precision"),
        *core("recall"),
        *core("best_t"),
        *low("best_t"),
    )


TOP_ORDER = ("q25_f2", "median_f2", "mean_f2")
