"""Exact distribution summaries that never put one group into one task.

Values get an order-preserving bin and are counted per bin (map-side combine, a table that does not
grow with the rows).  Running counts over the bins tell which of them hold a wanted rank, and only the values
inside those are ranked.  A group holding a third of all rows is spread over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
TAILS = (0.01, 0.05, 0.5, 0.95, 0.99)
BINS_PER_OCTAVE = 1024


def value_bin(value: Column, resolution: int = BINS_PER_OCTAVE) -> Column:
    """Bin number that never decreases as the value grows (logarithmic in the magnitude)."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + F.lit(1.0)) * F.lit(float(resolution)))


def percentile_name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def value_counts(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., metric, value, n)``: how often each value of each metric occurs; nulls are left out."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    long = df.select(*by, F.explode(F.array(*pairs)).alias("pair")).select(*by, "pair.metric", "pair.value")
    return long.filter(F.col("value").isNotNull()).groupBy(*by, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_values(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values with ``first_rank`` (0-based), group size ``total`` and group mean.

    ``keys`` may hold nulls (grouping levels), so they are compared null-safely.
    """
    binned = counts.withColumn("_bin", value_bin(F.col("value")))
    per_bin = binned.groupBy(*keys, "_bin").agg(
        F.sum("n").alias("_bin_n"), F.sum(F.col("n") * F.col("value")).alias("_bin_sum")
    )
    group = W.partitionBy(*keys)
    before = group.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = per_bin.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bin").alias("_b"),
        (F.sum("_bin_n").over(before) - F.col("_bin_n")).alias("_offset"),
        F.sum("_bin_n").over(group).alias("total"),
        (F.sum("_bin_sum").over(group) / F.sum("_bin_n").over(group)).alias("mean"),
    )
    # Null-safe throughout: a plain equality would push "is not null" tests of the bin down into one
    # of the two uses of the counts, which would then no longer share their shuffle.
    same = F.col("_bin").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = W.partitionBy(*keys, "_bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        binned.join(offsets, same)
        .withColumn("first_rank", F.col("_offset") + F.sum("n").over(inside) - F.col("n"))
        .select(*keys, "value", "n", "first_rank", "total", "mean")
    )


def percentile_at(p: float) -> Column:
    """Aggregate over :func:`ranked_values`: percentile with linear interpolation."""
    position = (F.col("total") - 1) * F.lit(float(p))
    low, high = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        here = (F.col("first_rank") <= rank) & (rank < F.col("first_rank") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    return at(low) + (at(high) - at(low)) * F.max(position - low)


def describe(
    df: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str] = (),
    probs: Sequence[float] = QUARTILES,
    digits: int | None = 3,
) -> DataFrame:
    """Count, mean, sample standard deviation, min, percentiles and max of each metric per group."""
    return _described(df, metrics, [list(by)], list(by), probs, digits).drop("level")


def describe_levels(
    df: DataFrame,
    metrics: Sequence[str],
    levels: Sequence[Sequence[str]],
    probs: Sequence[float] = TAILS,
    digits: int | None = 3,
) -> DataFrame:
    """:func:`describe` at several grouping levels (overall, per label, per group)."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    return _described(df, metrics, levels, columns, probs, digits)


def _described(
    df: DataFrame, metrics: Sequence[str], levels: Sequence[Sequence[str]], columns: list[str], probs: Sequence[float], digits: int | None
) -> DataFrame:
    """Summaries in two passes over the narrow values, which are written once.

    The first counts values per bin, a table that does not grow with the rows; it gives all moments, and the few bins
    that hold a wanted rank.  The second ranks the values of those bins only.
    """
    narrow = cut_lineage(df.select(*columns, *metrics))
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    values = narrow.select(*columns, F.explode(F.array(*pairs)).alias("_pair")).select(*columns, "_pair.*")
    values = values.filter(F.col("value").isNotNull()).withColumn("_bin", value_bin(F.col("value")))
    bins = values.groupBy(*columns, "metric", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"),
        F.min("value").alias("_min"), F.max("value").alias("_max"),
    )
    bins = cut_lineage(_per_level(bins, levels, columns))

    weighted = F.col("n") * F.col("_mean")
    whole = W.partitionBy("_key")
    centred = bins.withColumn("mean", F.sum(weighted).over(whole) / F.sum("n").over(whole))
    count = F.sum("n")
    squares = F.sum(F.col("n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("mean"), F.lit(2.0))))
    moments = centred.groupBy("_key").agg(
        count.alias("count"),
        F.max("mean").alias("mean"),
        F.when(count > 1, F.sqrt(squares / (count - 1))).alias("std"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
    )

    per_bin = bins.groupBy("_key", "_bin").agg(F.sum("n").alias("n"))
    upto = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = per_bin.withColumns({"_before": F.sum("n").over(upto) - F.col("n"), "_total": F.sum("n").over(whole)})
    wanted = []
    for i, p in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(i).alias("p"), F.lit(side).alias("side"), rank.alias("rank"), (position - F.floor(position)).alias("part"))
                   for side, rank in (("low", F.floor(position)), ("high", F.ceil(position)))]
    ranks = placed.withColumn("_w", F.explode(F.array(*wanted))).filter(
        (F.col("_w")["rank"] >= F.col("_before")) & (F.col("_w")["rank"] < F.col("_before") + F.col("n"))
    )
    ranks = cut_lineage(ranks.select("_key", "_bin", "_before", "_w.*"))

    # At most two bins per percentile and group are looked into.
    inside = values.join(ranks.select(F.col("_key")["metric"].alias("metric"), "_bin").distinct(), ["metric", "_bin"], "left_semi")
    inside = _per_level(inside.groupBy(*columns, "metric", "_bin", "value").agg(F.count(F.lit(1)).alias("n")), levels, columns)
    inside = inside.join(ranks.select("_key", "_bin", "_before").distinct(), ["_key", "_bin"])
    inside = inside.groupBy("_key", "_bin", "_before", "value").agg(F.sum("n").alias("n"))
    order = W.partitionBy("_key", "_bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("_from", F.col("_before") + F.sum("n").over(order) - F.col("n")).drop("_before")
    hit = (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_from") + F.col("n"))
    found = ranked.join(ranks, ["_key", "_bin"]).filter(hit)

    def at(i: int, side: str, what: str = "value") -> Column:
        return F.max(F.when((F.col("p") == i) & (F.col("side") == side), F.col(what)))

    percentiles = found.groupBy("_key").agg(
        *[(at(i, "low") + (at(i, "high") - at(i, "low")) * at(i, "low", "part")).alias(percentile_name(p)) for i, p in enumerate(probs)]
    )
    out = moments.join(percentiles, "_key")
    names = ["mean", "std", "min", *[percentile_name(p) for p in probs], "max"]
    rounded = [(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in names]
    return out.select("_key.level", *[F.col("_key")[c].alias(c) for c in columns], "_key.metric", "count", *rounded)


def _per_level(rows: DataFrame, levels: Sequence[Sequence[str]], columns: list[str]) -> DataFrame:
    """Rows once per grouping level, with ``_key``: level, its columns (null outside of it) and metric."""
    keys = [
        F.struct(
            F.lit("+".join(level) or "overall").alias("level"),
            *[(F.col(c) if c in level else F.lit(None).cast("string")).alias(c) for c in columns],
            F.col("metric").alias("metric"),
        )
        for level in levels
    ]
    return rows.withColumn("_key", F.explode(F.array(*keys))).drop(*columns, "metric")
