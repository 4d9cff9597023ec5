"""Deterministic draws and feature signatures.

All randomness in the library is an md5 of a stable key, so a result does not depend on how rows
are spread over partitions and survives the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T


def _part(value: Column | str | int) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def hash_draw(salt: str, seed: int, split_id: Column | int, key: Column) -> Column:
    """Hex digest that serves as a uniform draw for (salt, seed, split, key)."""
    return F.md5(F.concat_ws("|", _part(salt), _part(seed), _part(split_id), _part(key)))


def signature_part(name: str, data_type: T.DataType) -> Column:
    """One feature as text: six decimals for fractions, ``nan`` for null."""
    col = F.col(name)
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        text = F.format_string("%.6f", col.cast("double"))
        return F.when(col.isNull() | F.isnan(col.cast("double")), F.lit("nan")).otherwise(text)
    return F.coalesce(col.cast("string"), F.lit("nan"))


def feature_signature(types: Mapping[str, T.DataType]) -> Column:
    """All features of a row joined with ``|``; equal signatures mean equal features."""
    return F.concat_ws("|", *[signature_part(n, t) for n, t in types.items()])
