"""Escalation run: annotate reports (through the cache) or match rules, decide, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.labels import encode_label, encode_prediction
from ..functions.rules import RED_FLAGS, Dictionary
from ..operators.annotation import (
    Annotator,
    annotate,
    latest_responses,
    normalize_responses,
    probe_cache,
    split_quarantine,
    with_cache_key,
)
from ..operators.decisions import decide, error_profile, errors, match_rules
from ..operators.evaluation import classification_report, confusion, with_binary_metrics
from ..session import cut_lineage
from ..sources.tables import append_cache, read_cache

# Instructions to the annotator, allowed values and record schema.
PROMPT = """You are a clinical decision support assistant.
Your task is not to diagnose, but to assess clinical risk and the 
need for escalation based solely on the provided text.
If information is missing or ambiguous, you must explicitly state 
uncertainty.
Return only valid JSON. No explanations."""
ALLOWED_VALUES = """Allowed values:
- severity: ["low", "medium", "high"]
- uncertainty_level: ["low", "medium", "high"]
- confidence: float between 0.0 and 1.0
  where 1.0 means very certain and 0.0 means highly uncertain.
  If information is missing, ambiguous, or contradictory, confidence MUST be below 0.5."""
NAMESPACE = "escalation_check"


@dataclass(frozen=True)
class Evaluation:
    """Confusion counts with metrics, class report, and wrong decisions with their profile."""

    metrics: DataFrame
    report: DataFrame
    errors: DataFrame
    error_profile: DataFrame | None


def evaluate(decided: DataFrame, pred_col: str, truth_col: str = "expected_action", by: tuple[str, ...] = ()) -> Evaluation:
    """Encode truth and prediction, count, and derive all metrics from the counts."""
    encoded = decided.withColumns({"label": encode_label(truth_col), "prediction": encode_prediction(pred_col)})
    counts = confusion(encoded, by)
    wrong = errors(decided, pred_col, truth_col)
    profiled = {"severity", "uncertainty_level", "confidence_derived"} <= set(decided.columns)
    return Evaluation(
        with_binary_metrics(counts),
        classification_report(counts, by),
        wrong,
        error_profile(wrong) if profiled else None,
    )


def escalate_by_rules(reports: DataFrame, dictionary: Dictionary = RED_FLAGS, mode: str = "word") -> DataFrame:
    """Reports with ``expected_action_rule``."""
    return match_rules(reports, dictionary, mode=mode)


def annotated_signals(
    reports: DataFrame,
    annotator: Annotator,
    cache_path: str,
    prompt: str = PROMPT,
    namespace: str = NAMESPACE,
    extra: str = "",
) -> tuple[DataFrame, DataFrame]:
    """``(signals, quarantined)``: annotate only texts that the cache does not hold.

    Fresh responses are appended to the cache first and all signals are then read from it, so a
    retried task or a lost executor never pays for a text twice once it is written.
    """
    spark = reports.sparkSession
    keyed = with_cache_key(reports, prompt, namespace, extra=extra)
    _, misses = probe_cache(keyed, read_cache(spark, cache_path))
    append_cache(annotate(misses, annotator), cache_path)
    # The texts stay behind: from here on a report is its key.  A key that still has no response
    # goes to quarantine like an unusable one.
    answers = latest_responses(read_cache(spark, cache_path))
    answered = keyed.drop("report_text").join(answers, "cache_key", "left")
    # Written once: both results start from it.
    return split_quarantine(cut_lineage(normalize_responses(answered)))


def escalate_by_annotator(
    reports: DataFrame, annotator: Annotator, cache_path: str, rule_version: str = "v6", **key
) -> tuple[DataFrame, DataFrame]:
    """``(decided, quarantined)``: signals with ``expected_action_final`` of the rule version."""
    signals, quarantined = annotated_signals(reports, annotator, cache_path, **key)
    return decide(signals, rule_version), quarantined
