"""Keyword rule, decision rules and the comparison of decisions with the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import error_type, label_text
from ..functions.rules import Dictionary, RED_FLAGS, Signals, decision, dictionary_hits, keywords_found
from .frames import compute_once

# Columns of the error profile.
PROFILE_COLUMNS = (
    "domain",
    "clarity",
    "n_risk_factors",
    "n_missing_information",
    "severity",
    "confidence",
    "uncertainty_level",
    "confidence_derived",
)


def match_rules(
    df: DataFrame, dictionary: Dictionary = RED_FLAGS, text_col: str = "report_text", mode: str = "word"
) -> DataFrame:
    """Add ``hits`` (category, keyword pairs) and ``expected_action_rule`` (any hit).

    The dictionary is part of the expression; no join and no shuffle.
    """
    keywords = [k for ks in dictionary.values() for k in ks]
    hits = dictionary_hits(keywords_found(text_col, keywords, mode), dictionary)
    return compute_once(df, {"hits": hits}).withColumn("expected_action_rule", F.size("hits") > 0)


def rule_hits(matched: DataFrame, *keep: str) -> DataFrame:
    """One row per hit of :func:`match_rules`."""
    return matched.select(*keep, F.explode("hits").alias("hit")).select(*keep, "hit.category", "hit.keyword")


def decide(
    df: DataFrame,
    version: str,
    action_col: str = "expected_action_llm",
    out_col: str = "expected_action_final",
    signals: Signals | None = None,
) -> DataFrame:
    """Add the final action and the rule version that made it."""
    return df.withColumns(
        {
            out_col: decision(version, action_col, signals or Signals.named()),
            "rule_version": F.lit(version),
        }
    )


def with_label_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Boolean decision columns as label texts; columns of other types are left alone."""
    booleans = {c for c, t in df.dtypes if t == "boolean"}
    return df.withColumns({c: label_text(c) for c in columns if c in booleans})


def with_error_type(df: DataFrame, pred_col: str, truth_col: str = "expected_action") -> DataFrame:
    """Add ``error_type``: false_negative, false_positive or null."""
    return df.withColumn("error_type", error_type(truth_col, pred_col))


def errors(df: DataFrame, pred_col: str, truth_col: str = "expected_action", kind: str | None = None) -> DataFrame:
    """Wrong decisions in one pass; ``kind`` keeps one sort of error."""
    wrong = with_error_type(df, pred_col, truth_col)
    return wrong.filter(F.col("error_type") == kind) if kind else wrong.filter(F.col("error_type").isNotNull())


def scored_errors(scored: DataFrame, label_col: str = "label", pred_col: str = "prediction", key: str = "row_key") -> DataFrame:
    """Row keys of the wrong decisions of a scored model."""
    kind = F.when((F.col(label_col) == 1) & (F.col(pred_col) == 0), F.lit("false_negative")).when(
        (F.col(label_col) == 0) & (F.col(pred_col) == 1), F.lit("false_positive")
    )
    return scored.select(key, kind.alias("error_type")).filter(F.col("error_type").isNotNull())


def error_profile(wrong: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Per error type: how often each tuple of signal values occurs; tuples with a null are left out."""
    return wrong.dropna(subset=list(columns)).groupBy("error_type", *columns).agg(F.count(F.lit(1)).alias("n"))


def sorted_profile(profile: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS) -> DataFrame:
    """Error profile in report order: per error type and severity, most frequent first."""
    return profile.orderBy("error_type", "severity", F.col("n").desc(), *[c for c in columns if c != "severity"])


def disagreement(df: DataFrame, left: str, right: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose two columns differ; null equals null only."""
    return df.filter(~F.col(left).eqNullSafe(F.col(right))).select(*columns)


def count_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count per tuple (label distribution, agreement of runs)."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
