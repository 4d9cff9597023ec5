"""Exact ROC / precision-recall curves, their areas, and threshold sweeps.

Rows are counted per distinct score first.  Scores fall into order-preserving bins; running
counts over the bins give every bin its offset and a window inside each bin does the rest, so
neither a hot score nor a hot group ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .distribution import value_bin
from .evaluation import ratio, with_binary_metrics

STEPS = 100
CURVE_BINS = 4096


def default_thresholds() -> list[float]:
    """0.00, 0.01, ..., 1.00."""
    return [i * 0.01 for i in range(STEPS + 1)]


def score_counts(
    scored: DataFrame,
    by: Sequence[str] = (),
    score_col: str = "score",
    label_col: str = "label",
    weight_col: str | None = None,
) -> DataFrame:
    """``(by..., score, n, pos)`` per distinct score."""
    weight = F.col(weight_col) if weight_col else F.lit(1)
    return scored.groupBy(*by, F.col(score_col).alias("score")).agg(
        F.sum(weight).cast("bigint").alias("n"), F.sum(weight * F.col(label_col)).cast("bigint").alias("pos")
    )


def curve_points(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: counts at or above it, and totals.

    ``counts`` comes from :func:`score_counts`.  Output columns: ``n, pos`` (at the score),
    ``tp, fp`` (at or above it), ``n_pos, n_neg`` (totals).
    """
    by = list(by)
    binned = counts.withColumn("_bin", value_bin(F.col("score"), CURVE_BINS))
    per_bin = binned.groupBy(*by, "_bin").agg(F.sum("n").alias("_bn"), F.sum("pos").alias("_bp"))
    # At most a few thousand rows per group; without groups this is one small window.
    group = W.partitionBy(*(by or [F.lit(0)]))
    above = group.orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = per_bin.select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        F.col("_bin").alias("_b"),
        (F.sum("_bn").over(above) - F.col("_bn")).alias("_on"),
        (F.sum("_bp").over(above) - F.col("_bp")).alias("_op"),
        F.sum("_bp").over(group).alias("n_pos"),
        (F.sum("_bn").over(group) - F.sum("_bp").over(group)).alias("n_neg"),
    )
    # Null-safe, so that both uses of the counts keep the same plan and share their shuffle.
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = (
        W.partitionBy(*by, "_bin").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        binned.join(offsets, same)
        .withColumn("tp", F.col("_op") + F.sum("pos").over(inside))
        .withColumn("fp", F.col("_on") + F.sum("n").over(inside) - F.col("tp"))
        .select(*by, "score", "n", "pos", "tp", "fp", "n_pos", "n_neg")
    )


def roc_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(score, fpr, tpr)`` per distinct score."""
    return points.select(
        *by,
        "score",
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def pr_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(score, recall, precision)`` per distinct score."""
    return points.select(
        *by,
        "score",
        ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def curve_areas(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count half; null with one class) and ``pr_auc`` (average precision)."""
    neg = F.col("n") - F.col("pos")
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    pairs = F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    gain = F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return points.groupBy(*by).agg(
        n_pos.alias("n_pos"),
        n_neg.alias("n_neg"),
        (pairs / F.nullif(n_pos.cast("double") * n_neg.cast("double"), F.lit(0.0))).alias("roc_auc"),
        ratio(gain, n_pos).alias("pr_auc"),
    )


def thresholds_reached(score_col: str, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the score reaches, as a binary search in one expression."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{score_col}` >= {thresholds[mid]!r}D THEN {search(mid + 1, hi)} ELSE {search(lo, mid)} END"

    return F.expr(search(0, len(thresholds)))


def threshold_sweep(
    scored: DataFrame,
    by: Sequence[str] = (),
    thresholds: Sequence[float] | None = None,
    score_col: str = "score",
    label_col: str = "label",
    weight_col: str | None = None,
) -> DataFrame:
    """Metrics of ``score >= t`` for every threshold.

    One shuffle of at most ``len(thresholds) + 1`` counters per group and task; the counters of a
    group then unfold into running sums over its thresholds.
    """
    by = list(by)
    cuts = sorted(float(t) for t in (thresholds if thresholds is not None else default_thresholds()))
    weight = F.col(weight_col) if weight_col else F.lit(1)
    histogram = scored.groupBy(*by, thresholds_reached(score_col, cuts).alias("_k")).agg(
        F.sum(weight).cast("bigint").alias("_n"), F.sum(weight * F.col(label_col)).cast("bigint").alias("_p")
    )
    # Counter k covers scores that reach thresholds 0..k-1; one array per group of at most 102 counters.
    cells = F.map_from_entries(F.collect_list(F.struct("_k", F.struct("_n", "_p"))))
    packed = histogram.groupBy(*by).agg(cells.alias("_cells"), F.sum("_n").alias("n_test"), F.sum("_p").alias("n_pos"))
    ladder = F.expr(f"array({', '.join(f'{t!r}D' for t in cuts)})")
    unfolded = packed.select(*by, "n_test", "n_pos", "_cells", F.posexplode(ladder).alias("_i", "threshold"))

    def at_or_above(field: str) -> Column:
        reached = F.filter(F.map_entries("_cells"), lambda e: e["key"] > F.col("_i"))
        return F.aggregate(reached, F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"][field])

    rows = unfolded.select(
        *by,
        "threshold",
        "n_test",
        "n_pos",
        at_or_above("_p").alias("tp"),
        at_or_above("_n").alias("_selected"),
    ).withColumns({"fp": F.col("_selected") - F.col("tp"), "fn": F.col("n_pos") - F.col("tp")})
    return (
        with_binary_metrics(rows)
        .withColumn("pos_rate", ratio(F.col("n_pos"), F.col("n_test")))
        .select(*by, "threshold", "n_test", "n_pos", "pos_rate", "precision", "recall", "f1", "f2")
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), metric: str = "f2") -> DataFrame:
    """The row with the best metric per group; the lowest threshold wins a tie."""
    if metric not in ("precision", "recall", "f1", "f2"):
        raise ValueError(f"unknown metric: {metric}")
    rest = [c for c in sweep.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")
