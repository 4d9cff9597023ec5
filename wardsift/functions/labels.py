"""Label and prediction expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import ESCALATE, NO_ESCALATE


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def label_text(flag: Column | str) -> Column:
    """Boolean decision as label text; null stays null."""
    flag = _col(flag)
    return F.when(flag, F.lit(ESCALATE)).when(~flag, F.lit(NO_ESCALATE))


def encode_label(label: Column | str) -> Column:
    """Truth text as 0/1.  Any other value, null included, fails the job."""
    label = _col(label)
    return (
        F.when(label == ESCALATE, F.lit(1))
        .when(label == NO_ESCALATE, F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int"))
    )


def encode_prediction(flag: Column | str) -> Column:
    """Boolean prediction as 0/1.  Null fails the job."""
    flag = _col(flag)
    return (
        F.when(flag, F.lit(1))
        .when(~flag, F.lit(0))
        .otherwise(F.raise_error(F.lit("invalid prediction: null")).cast("int"))
    )


def lenient_double(value: Column | str) -> Column:
    """Text as a number; null where it is none."""
    return _col(value).try_cast("double")


def decision_at(score: Column | str, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(score) >= cut).cast("int")


def error_type(truth: Column | str, flag: Column | str) -> Column:
    """``false_negative``, ``false_positive`` or null for a right (or absent) decision."""
    truth, flag = _col(truth), _col(flag)
    return F.when((truth == ESCALATE) & ~flag, F.lit("false_negative")).when(
        (truth == NO_ESCALATE) & flag, F.lit("false_positive")
    )
