"""Text profile of a report table, computed from one scan of the texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import METRICS, text_hash
from ..operators.distribution import describe, describe_levels
from ..operators.profile import extreme_rates, with_text_metrics
from ..session import cut_lineage


@dataclass(frozen=True)
class TextProfile:
    """Narrow per-report metrics and the summaries drawn from them."""

    metrics: DataFrame
    describe_overall: DataFrame
    describe_by_group: DataFrame
    tails: DataFrame
    extremes: DataFrame


def profile_texts(
    reports: DataFrame, group_col: str = "domain", label_col: str = "expected_action", key: str = "case_id"
) -> TextProfile:
    """Measure every text once, write the narrow table to the checkpoint folder, summarise that."""
    measured = with_text_metrics(reports).select(
        key, group_col, label_col, text_hash("report_text").alias("text_hash"), *[F.col(m) for m in METRICS]
    )
    table = cut_lineage(measured)
    return TextProfile(
        table,
        describe(table, METRICS),
        describe(table, METRICS, [group_col]),
        describe_levels(table, METRICS, [[], [label_col], [group_col]]),
        extreme_rates(table),
    )
