"""Column renames, merges of runs, top-k tables and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Filters and join conditions on an ordinary computed column are pushed down as copies of its
    expression.  For costly ones (parsing, regular expressions over whole texts) the columns pass
    through a one-element ``explode``, which such copies do not cross.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(packed).alias("_once")).select(*kept, *[F.col("_once")[n].alias(n) for n in columns])


def rename_by_split(df: DataFrame, separator: str = " ") -> DataFrame:
    """Cut every column name at the first separator; a clash of names is an error."""
    names = [c.split(separator)[0] if separator in c else c for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"renaming makes columns clash: {clashes}")
    return df.toDF(*names)


def drop_columns(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` wants all of them to exist."""
    missing = sorted(set(columns) - set(df.columns))
    if strict and missing:
        raise ValueError(f"columns to drop are missing: {missing}")
    return df.drop(*columns)


def merge_runs(
    runs: Sequence[DataFrame],
    on: Sequence[str] | str,
    drop: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join runs on their keys; every other column carries the index of its run.

    All joins share the same keys, so the running result keeps its partitioning and each run is
    shuffled once.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("merge needs at least one key column")
    prepared = []
    for i, run in enumerate(runs):
        absent = [k for k in keys if k not in run.columns]
        if absent:
            raise ValueError(f"run {i} lacks key columns {absent}")
        kept = [c for c in run.columns if c not in drop and c not in keys]
        prepared.append(run.select(*keys, *[F.col(f"`{c}`").alias(f"{c}_{i}") for c in kept]))
    return reduce(lambda left, right: left.join(right, keys, how), prepared)


def compare_runs(runs: dict[str, DataFrame], on: Sequence[str], column: str) -> DataFrame:
    """One column of several runs side by side with a single shuffle (union and pivot).

    Keys missing from a run get null, as in a full join; keys must be unique inside a run.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(*on, F.lit(name).alias("_run"), F.col(column).alias("_value")) for name, df in runs.items()],
    )
    picked = [F.max(F.when(F.col("_run") == name, F.col("_value"))).alias(f"{column}_{name}") for name in runs]
    return stacked.groupBy(*on).agg(*picked)


def sort_top_k(
    df: DataFrame, sort: Sequence[str], extract: Sequence[str], k: int, tie_break: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Whole table sorted downwards, and the chosen columns of its first ``k`` rows."""
    order = [F.col(c).desc() for c in sort] + ([F.col(tie_break).asc()] if tie_break else [])
    ordered = df.orderBy(*order)
    return ordered, ordered.limit(k).select(*extract)


def integrity(df: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """One row: rows, repeated keys, all-null rows.  Missing required columns are an error."""
    absent = [c for c in (key, *required) if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    empty: Column = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in df.columns])
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(empty).alias("_empty"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.col("_n") - 1).alias("n_repeated_keys"),
        F.sum("_empty").alias("n_all_null"),
    )


def check_same_columns(left: DataFrame, right: DataFrame) -> None:
    """Train and test side must have the same columns in the same order."""
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
