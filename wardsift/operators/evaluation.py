"""Confusion counts and the metrics that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ESCALATE, NO_ESCALATE

COUNTS = ("tn", "fp", "fn", "tp")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient with 0 for a zero denominator."""
    return F.coalesce(numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion(
    df: DataFrame,
    by: Sequence[str] = (),
    label_col: str = "label",
    pred_col: str = "prediction",
    weight_col: str | None = None,
) -> DataFrame:
    """``tn, fp, fn, tp`` per group for 0/1 labels and predictions, in one aggregation."""
    weight = F.col(weight_col) if weight_col else F.lit(1)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    sums = [
        F.sum(F.when((F.col(label_col) == y) & (F.col(pred_col) == p), weight).otherwise(0)).cast("bigint").alias(name)
        for name, (y, p) in cells.items()
    ]
    return df.groupBy(*by).agg(*sums)


def f_score(beta: float, tp: Column, fp: Column, fn: Column) -> Column:
    b2 = beta * beta
    return ratio(F.lit(1.0 + b2) * tp, F.lit(1.0 + b2) * tp + F.lit(b2) * fn + fp)


def with_binary_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and F2 of the positive class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f_score(1.0, tp, fp, fn),
            "f2": f_score(2.0, tp, fp, fn),
        }
    )


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class plus accuracy, macro and weighted averages, from confusion counts."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp

    def of_class(hit: Column, false_alarm: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": ratio(hit, hit + false_alarm),
            "recall": ratio(hit, hit + missed),
            "f1": f_score(1.0, hit, false_alarm, missed),
            "support": hit + missed,
        }

    negative, positive = of_class(tn, fn, fp), of_class(tp, fp, fn)
    accuracy = ratio(tn + tp, n)
    names = ("precision", "recall", "f1")
    macro = {k: (negative[k] + positive[k]) / F.lit(2.0) for k in names}
    weighted = {
        k: ratio(negative[k] * negative["support"] + positive[k] * positive["support"], n) for k in names
    }

    def row(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), *[values[k].alias(k) for k in names], support.alias("support"))

    rows = F.array(
        row(NO_ESCALATE, negative, negative["support"]),
        row(ESCALATE, positive, positive["support"]),
        row("accuracy", {k: accuracy for k in names}, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    )
    return counts.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
