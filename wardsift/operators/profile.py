"""Text profile of a report table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import METRICS, char_ratio, text_hash, text_metrics
from .distribution import percentile_at, ranked_values, value_counts
from .frames import compute_once

TINY_WORDS = 3
HUGE_QUANTILE = 0.99
RATIOS = {"digit_ratio": "n_digits", "upper_ratio": "n_upper", "punct_ratio": "n_punct"}


def with_text_metrics(df: DataFrame, text_col: str = "report_text", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Add text metrics (all nine by default); a null or empty text counts as zero everywhere."""
    unknown = sorted(set(metrics) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown text metrics: {unknown}")
    parts = {m: (RATIOS[m], "n_chars") if m in RATIOS else (m,) for m in metrics}
    needed = {part for names in parts.values() for part in names}
    counted = compute_once(df, {name: c for name, c in text_metrics(text_col).items() if name in needed})
    ratios = {m: char_ratio(RATIOS[m]) for m in metrics if m in RATIOS}
    kept = [c for c in df.columns if c not in metrics]
    return (counted.withColumns(ratios) if ratios else counted).select(*[F.col(f"`{c}`") for c in kept], *metrics)


def sanity_profile(df: DataFrame, text_col: str = "report_text", label_col: str = "expected_action") -> DataFrame:
    """Rows per label (null included), with the null and empty shares of all texts.

    The shares come from the same per-label counts, so the texts are scanned once.
    """
    for col in (text_col, label_col):
        if col not in df.columns:
            raise ValueError(f"missing column: {col}")
    text = F.col(text_col)
    per_label = df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("n_label"),
        F.count_if(text.isNull()).alias("_nulls"),
        F.count_if(F.length(text) == 0).alias("_empty"),
        F.count(text).alias("_texts"),
    )
    shares = per_label.agg(
        F.struct(
            (F.sum("_nulls") / F.sum("n_label")).alias("null_share"),
            (F.sum("_empty") / F.nullif(F.sum("_texts"), F.lit(0))).alias("empty_share"),
        )
    ).scalar()
    return per_label.select(
        label_col,
        "n_label",
        shares["null_share"].alias("mean_null_text"),
        shares["empty_share"].alias("mean_empty_text"),
    )


def huge_threshold(df: DataFrame, quantile: float = HUGE_QUANTILE, words_col: str = "n_words") -> DataFrame:
    """One row ``huge_words``: the exact quantile of the word counts."""
    ranked = ranked_values(value_counts(df, [words_col]), ["metric"])
    return ranked.agg(percentile_at(quantile).alias("huge_words"))


def extreme_flags(df: DataFrame, quantile: float = HUGE_QUANTILE) -> DataFrame:
    """Add ``is_empty``, ``is_tiny`` and ``is_huge`` to rows that carry ``n_chars`` and ``n_words``."""
    return df.withColumns(
        {
            "is_empty": F.col("n_chars") == 0,
            "is_tiny": F.col("n_words") <= TINY_WORDS,
            "is_huge": F.col("n_words") >= huge_threshold(df, quantile).scalar(),
        }
    )


def extreme_rates(df: DataFrame, quantile: float = HUGE_QUANTILE) -> DataFrame:
    """Share of each flag, from counted (chars, words) pairs: the texts are scanned once."""
    pairs = df.select("n_chars", "n_words").groupBy((F.col("n_chars") == 0).alias("_empty"), "n_words").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = pairs.select(F.lit("n_words").alias("metric"), F.col("n_words").cast("double").alias("value"), "n", "_empty")
    ranked = ranked_values(counts.groupBy("metric", "value").agg(F.sum("n").alias("n")), ["metric"])
    cut = ranked.agg(percentile_at(quantile)).scalar()
    total = F.sum("n")
    return counts.withColumn("huge_words", cut).agg(
        (F.sum(F.when(F.col("_empty"), F.col("n")).otherwise(0)) / total).alias("rate_empty"),
        (F.sum(F.when(F.col("value") <= TINY_WORDS, F.col("n")).otherwise(0)) / total).alias("rate_tiny"),
        (F.sum(F.when(F.col("value") >= F.col("huge_words"), F.col("n")).otherwise(0)) / total).alias("rate_huge"),
    )


def sample_heads(df: DataFrame, flags: dict[str, int], columns: Sequence[str], order: str = "case_id") -> DataFrame:
    """First rows per flag by ``order`` (as many as the flag asks for): a report of examples.

    All flags are served by one scan; the rank limit is pushed below the shuffle.
    """
    marks = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("on"), F.lit(n).alias("n")) for f, n in flags.items()])
    marked = df.select(order, *columns, F.explode(marks).alias("_m")).filter(F.col("_m")["on"])
    ranked = marked.select("_m.flag", "_m.n", order, *columns).withColumn(
        "_rn", F.row_number().over(W.partitionBy("flag").orderBy(order))
    )
    most = max(flags.values())
    return ranked.filter(F.col("_rn") <= most).filter(F.col("_rn") <= F.col("n")).drop("n", "_rn")


def duplicate_rate(df: DataFrame, text_col: str = "report_text") -> DataFrame:
    """Share of rows whose text (case and outer space ignored) occurred before."""
    per_hash = df.groupBy(text_hash(text_col).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    return per_hash.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.lit(1.0) - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate"),
    )
