"""Keyword dictionary and versioned decision rules as expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import WORD_CHARS, words

# Keyword dictionary by category.
RED_FLAGS = {
    "sepsis": ["fieber", "hypoton", "tachykard", "schüttelfrost", "somnolent", "septisch"],
    "cardiac": ["thoraxschmerz", "herzinsuffizienz", "dyspnoe", "ödem", "ödematös"],
    "neurologic": ["verwirrt", "lähmung", "sprachstörung", "krampfanfall", "bewusstseinsstörung"],
    "bleeding": ["hämatemesis", "meläna", "blutung", "teerstuhl"],
}

Dictionary = Mapping[str, Sequence[str]]


def _quote(keyword: str) -> str:
    """Keyword as a literal for the JVM's regular expressions."""
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in keyword)


def keywords_found(text: Column | str, keywords: Sequence[str], mode: str = "word") -> Column:
    """Keywords of the list that occur in the text: single words in list order, then phrases.

    ``word`` wants the whole word (or phrase); ``prefix`` wants the start of a word.  Single words
    are looked up in the set of words of the text, so the cost does not grow with the dictionary.
    """
    if mode not in ("word", "prefix"):
        raise ValueError(f"unknown match mode: {mode}")
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")
    unique = list(dict.fromkeys(k.lower() for k in keywords))
    single = [k for k in unique if mode == "word" and all(c.isalnum() or c == "_" for c in k)]
    end = "" if mode == "prefix" else f"(?![{WORD_CHARS}])"
    present = none
    if single:
        present = F.array_intersect(F.array(*[F.lit(k) for k in single]), F.coalesce(words(text), none))
    patterns = {k: f"(?<![{WORD_CHARS}]){_quote(k)}{end}" for k in unique if k not in single}
    if not patterns:
        return present
    tests = [F.when(F.regexp_like(F.lower(text), F.lit(p)), F.lit(k)) for k, p in patterns.items()]
    # Most texts hold no keyword: one test for any of them saves the test of each.
    any_of = f"(?<![{WORD_CHARS}])(?:{'|'.join(_quote(k) for k in patterns)}){end}"
    matched = F.when(F.regexp_like(F.lower(text), F.lit(any_of)), F.array_compact(F.array(*tests))).otherwise(none)
    return F.concat(present, matched) if single else matched


def dictionary_hits(found: Column | str, dictionary: Dictionary) -> Column:
    """(category, keyword) pairs of the dictionary for each keyword in ``found``.

    The dictionary is a constant map from keyword to its pairs, looked up once per found keyword.
    """
    found = F.col(found) if isinstance(found, str) else found
    pairs: dict[str, list[Column]] = {}
    for category, keywords in dictionary.items():
        for keyword in dict.fromkeys(k.lower() for k in keywords):
            pair = F.struct(F.lit(category).alias("category"), F.lit(keyword).alias("keyword"))
            pairs.setdefault(keyword, []).append(pair)
    entries = [part for keyword, found_pairs in pairs.items() for part in (F.lit(keyword), F.array(*found_pairs))]
    lookup = F.create_map(*entries)
    return F.flatten(F.transform(found, lambda k: F.element_at(lookup, k)))


@dataclass(frozen=True)
class Signals:
    """Columns a decision rule may look at."""

    severity: Column
    uncertainty: Column
    confidence: Column
    n_risk: Column
    n_missing: Column

    @staticmethod
    def named(
        severity: str = "severity",
        uncertainty: str = "uncertainty_level",
        confidence: str = "confidence",
        n_risk: str = "n_risk_factors",
        n_missing: str = "n_missing_information",
    ) -> "Signals":
        return Signals(F.col(severity), F.col(uncertainty), F.col(confidence), F.col(n_risk), F.col(n_missing))


@dataclass(frozen=True)
class DecisionRule:
    """``lower`` withdraws a positive raw action, ``raise_`` grants a negative one."""

    lower: Callable[[Signals], Column] | None = None
    raise_: Callable[[Signals], Column] | None = None


def _hesitant_low(s: Signals) -> Column:
    return (s.severity == "low") & (s.confidence < 0.4) & (s.uncertainty == "high")


def _low(s: Signals) -> Column:
    return s.severity == "low"


def _medium_without_findings(s: Signals) -> Column:
    return (s.severity == "medium") & (s.n_risk == 0) & (s.n_missing == 0)


def _high_or_supported_medium(s: Signals) -> Column:
    supported = (s.confidence >= 0.8) | (s.n_missing >= 2) | (s.n_risk >= 2)
    return (s.severity == "high") | ((s.severity == "medium") & supported)


DECISION_RULES = {
    "baseline": DecisionRule(),
    "v2": DecisionRule(lower=_hesitant_low),
    "v3": DecisionRule(lower=_hesitant_low),
    "v4": DecisionRule(lower=_low, raise_=_high_or_supported_medium),
    "v5": DecisionRule(
        lower=lambda s: _low(s) | (_medium_without_findings(s) & (s.uncertainty == "low")),
        raise_=_high_or_supported_medium,
    ),
    "v6": DecisionRule(
        lower=lambda s: _low(s) | (_medium_without_findings(s) & (s.confidence >= 0.7)),
        raise_=_high_or_supported_medium,
    ),
}


def decision(version: str, action: Column | str, signals: Signals) -> Column:
    """Raw action after the rules of ``version``; null action stays null, null signals never fire."""
    if version not in DECISION_RULES:
        raise ValueError(f"unknown rule version: {version}")
    rule = DECISION_RULES[version]
    action = F.col(action) if isinstance(action, str) else action
    out = F.when(action.isNull(), F.lit(None).cast("boolean"))
    if rule.lower:
        out = out.when(action & F.coalesce(rule.lower(signals), F.lit(False)), F.lit(False))
    if rule.raise_:
        out = out.when(~action & F.coalesce(rule.raise_(signals), F.lit(False)), F.lit(True))
    return out.otherwise(action)
