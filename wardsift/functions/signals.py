"""Expressions over annotator records: keys, lists, defaults and derived confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import RESPONSE_TEXT

# Confidence implied by the stated uncertainty.
CONFIDENCE_BY_UNCERTAINTY = {"low": 0.85, "medium": 0.6, "high": 0.3}


# A quoted part of a list literal, with backslash escapes.
QUOTED = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _empty_list() -> Column:
    return F.array().cast("array<string>")


def cache_key(text: Column | str, prompt: str, namespace: str, extra: str = "") -> Column:
    """SHA-256 of prompt, text and namespace.  ``extra`` can add model name or schema version."""
    return F.sha2(F.concat(F.lit(prompt), _col(text), F.lit(namespace + extra)), 256)


def parse_list_text(value: Column | str) -> Column:
    """Text form of a list as an array of strings.

    ``[...]`` is read as a list literal (an unreadable one gives an empty list; ``None`` is a null element, ``True``
    and ``False`` are texts); otherwise the text is split on commas and trimmed; a single word without a comma, a blank or null is empty.
    """
    text = _col(value)
    is_literal = text.startswith("[") & text.endswith("]")
    # Quoted parts are matched first and kept, so that only constants outside of them are replaced.
    plain = F.regexp_replace(text, r",\s*\]$", "]")
    for constant, json_text in (("None", "null"), ("True", '"True"'), ("False", '"False"')):
        parts = F.regexp_extract_all(plain, F.lit(rf"(?s){QUOTED}|\b{constant}\b|."), F.lit(0))
        replaced = F.array_join(F.transform(parts, lambda p: F.when(p == constant, F.lit(json_text)).otherwise(p)), "")
        plain = F.when(text.contains(constant), replaced).otherwise(plain)
    literal = F.from_json(
        plain,
        "array<string>",
        {"allowBackslashEscapingAnyCharacter": "true"},
    )
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.when(is_literal, literal).when(text.contains(","), pieces), _empty_list())


def list_size(values: Column | str) -> Column:
    """Length of an array; 0 for null."""
    return F.coalesce(F.size(_col(values)), F.lit(0))


def confidence_derived(uncertainty: Column | str) -> Column:
    level = _col(uncertainty)
    out = None
    for name, value in CONFIDENCE_BY_UNCERTAINTY.items():
        out = F.when(level == name, F.lit(value)) if out is None else out.when(level == name, F.lit(value))
    return out


def parse_response(raw: Column | str) -> Column:
    """JSON text of one annotator record as a struct of texts."""
    return F.from_json(
        _col(raw), RESPONSE_TEXT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )


def response_action(record: Column) -> Column:
    """Action of a parsed record: default true, null when it is neither true nor false."""
    text = F.lower(F.trim(record["expected_action"]))
    return (
        F.when(record["expected_action"].isNull() | (text == "true"), F.lit(True)).when(text == "false", F.lit(False))
    )


def response_confidence(record: Column) -> Column:
    """Confidence of a parsed record: default 0.0, null when it is no number."""
    text = record["confidence"]
    return F.when(text.isNull(), F.lit(0.0)).otherwise(text.try_cast("double"))


def quarantine_reason(raw: Column, record: Column) -> Column:
    """Why a record cannot be used; null for a usable one."""
    return (
        F.when(raw.isNull() | record.isNull(), F.lit("no_response"))
        .when(record["_corrupt_record"].isNotNull(), F.lit("broken_json"))
        .when(response_action(record).isNull(), F.lit("bad_action"))
        .when(response_confidence(record).isNull(), F.lit("bad_confidence"))
    )
