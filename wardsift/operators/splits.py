"""Deterministic train/test splits.

A quota of rows or groups is drawn by finding, per stratum, the digest of the last row inside the
quota.  Only the rows of one 4-digit digest bucket are ever ranked, and assigning a row is then a
plain comparison with its stratum's cut: rows are not moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.hashing import feature_signature, hash_draw

SEED = 42
TEST_SHARE = 0.2
PREFIX_DIGITS = 4


def digest_cuts(draws: DataFrame, strata: Sequence[str], shares: Sequence[float], digest: str = "h") -> DataFrame:
    """``(strata..., share_no, cut)``: digest of the row at rank ``ceil(share * n)`` of each stratum.

    One row per stratum and share comes out; strata are labels or split ids, so it is small.
    """
    strata = list(strata)
    prefix = F.substring(digest, 1, PREFIX_DIGITS)
    histogram = draws.groupBy(*strata, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*strata)
    upto = whole.orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    quotas = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])
    boundary = (
        histogram.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_quota", F.explode(quotas))
        .withColumn("_rank", F.ceil(F.col("_quota")["share"] * F.col("_total")))
        .filter((F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto")))
        .select(
            *strata,
            "_prefix",
            F.col("_quota")["no"].alias("share_no"),
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_need"),
        )
    )
    # The boundary table has one row per stratum and share.
    inside = draws.withColumn("_prefix", prefix).join(F.broadcast(boundary), [*strata, "_prefix"])
    ranked = inside.withColumn("_rn", F.row_number().over(W.partitionBy(*strata, "share_no").orderBy(digest)))
    return ranked.filter(F.col("_rn") == F.col("_need")).select(*strata, "share_no", F.col(digest).alias("cut"))


def stratified_split(
    df: DataFrame,
    key: str,
    label_col: str = "label",
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    salt: str = "holdout",
    exact: bool = True,
    out_col: str = "role",
) -> DataFrame:
    """Add ``train``/``test`` per row.

    ``exact`` puts ``ceil(share * n)`` rows of each class into test; otherwise each row is drawn on
    its own and the share holds in expectation, without any shuffle.
    """
    drawn = df.withColumn("_h", hash_draw(salt, seed, 0, F.col(key)))
    if not exact:
        limit = F.lit(f"{min(int(test_share * 16**8), 16**8 - 1):08x}")
        test = F.substring("_h", 1, 8) < limit
        return drawn.withColumn(out_col, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_h")
    cuts = digest_cuts(drawn.select(label_col, F.col("_h").alias("h")), [label_col], [test_share])
    # One cut per class.
    joined = drawn.join(F.broadcast(cuts.select(label_col, "cut")), label_col, "left")
    role = F.when(F.col("_h") <= F.col("cut"), F.lit("test")).otherwise(F.lit("train"))
    return joined.withColumn(out_col, role).drop("_h", "cut").select(*df.columns, out_col)


def stratified_folds(
    df: DataFrame, key: str, label_col: str = "label", n_folds: int = 5, seed: int = SEED, salt: str = "folds"
) -> DataFrame:
    """Add ``fold`` (1..n): every class is cut into ``n_folds`` runs of equal size."""
    drawn = df.withColumn("_h", hash_draw(salt, seed, 0, F.col(key)))
    shares = [i / n_folds for i in range(1, n_folds)]
    cuts = digest_cuts(drawn.select(label_col, F.col("_h").alias("h")), [label_col], shares)
    # One row per class with at most n_folds - 1 cuts.
    per_class = cuts.groupBy(label_col).agg(F.collect_list("cut").alias("_cuts"))
    fold = F.size(F.filter("_cuts", lambda c: c < F.col("_h"))) + 1
    joined = drawn.join(F.broadcast(per_class), label_col, "left")
    return joined.withColumn("fold", fold).select(*df.columns, "fold")


def with_signature(df: DataFrame, features: Sequence[str], out_col: str = "group_key") -> DataFrame:
    """Add the feature signature; rows with equal features form one group."""
    types = {f: df.schema[f].dataType for f in features}
    return df.withColumn(out_col, feature_signature(types))


def group_sizes(df: DataFrame, group_col: str = "group_key", weight_col: str | None = None) -> DataFrame:
    """``(group_key, size)``: one row per group."""
    size = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    return df.groupBy(group_col).agg(size.cast("bigint").alias("size"))


def group_statistics(sizes: DataFrame) -> DataFrame:
    """Number of groups and a description of their sizes, from the size histogram."""
    from .distribution import QUARTILES, percentile_at, percentile_name, ranked_values

    counts = sizes.groupBy(F.col("size").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_values(counts.withColumn("metric", F.lit("size")), ["metric"])
    count = F.sum("n")
    squares = F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0)))
    return ranked.agg(
        count.alias("n_groups"),
        F.max("mean").alias("mean"),
        F.when(count > 1, F.sqrt(squares / (count - 1))).alias("std"),
        F.min("value").alias("min"),
        *[percentile_at(p).alias(percentile_name(p)) for p in QUARTILES],
        F.max("value").alias("max"),
    )


def group_shuffle_splits(
    sizes: DataFrame,
    n_splits: int | None,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    group_col: str = "group_key",
) -> DataFrame:
    """``(split_id, group_key, role)``: per split, ``ceil(share * groups)`` random groups in test."""
    if not n_splits:
        raise ValueError("group shuffle needs n_splits")
    drawn = sizes.select(group_col, F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split_id")).withColumn(
        "h", hash_draw("group_shuffle", seed, F.col("split_id"), F.col(group_col))
    )
    # One cut per split.
    cuts = digest_cuts(drawn, ["split_id"], [test_share]).select("split_id", "cut")
    role = F.when(F.col("h") <= F.col("cut"), F.lit("test")).otherwise(F.lit("train"))
    return drawn.join(F.broadcast(cuts), "split_id").select("split_id", group_col, role.alias("role"))


def deal_groups(histogram: Sequence[tuple[int, int]], n_folds: int) -> dict[int, list[int]]:
    """Largest group to the lightest fold: how many groups of each size go to each fold.

    Groups of equal size are interchangeable, so the histogram ``(size, groups)`` is enough; whole
    rounds over the folds in play are dealt at once.
    """
    loads = [0] * n_folds
    dealt: dict[int, list[int]] = {}
    for size, left in sorted(histogram, reverse=True):
        counts = [0] * n_folds
        while left:
            lightest = min(loads)
            in_play = [f for f in range(n_folds) if loads[f] < lightest + size]
            others = [load for load in loads if load >= lightest + size]
            rounds = left // len(in_play)
            if others:
                gap = min(others) - max(loads[f] for f in in_play)
                rounds = min(rounds, max(0, -(-gap // size) - 1))
            chosen = in_play if rounds else [loads.index(lightest)]
            for f in chosen:
                counts[f] += max(rounds, 1)
                loads[f] += size * max(rounds, 1)
            left -= max(rounds, 1) * len(chosen)
        dealt[size] = counts
    return dealt


def group_folds(
    sizes: DataFrame, n_folds: int | None, seed: int = SEED, group_col: str = "group_key"
) -> DataFrame:
    """``(group_key, size, fold)``: each group in one fold, folds balanced by rows.

    Only the histogram of group sizes visits the driver; N rows have at most sqrt(2N) distinct
    sizes.  Groups of one size are ordered by digest and handed to the folds in turn.
    """
    if not n_folds:
        raise ValueError("group k-fold needs the number of folds")
    spark = sizes.sparkSession
    histogram = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    n_groups = sum(n for _, n in histogram)
    if n_groups < n_folds:
        raise ValueError(f"{n_groups} groups cannot fill {n_folds} folds")
    rows = []
    for size, counts in deal_groups(histogram, n_folds).items():
        ends, total = [], 0
        for c in counts:
            total += c
            ends.append(total)
        rows.append((size, ends))
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    dealt = spark.createDataFrame(rows, schema)

    drawn = sizes.withColumn("h", hash_draw("group_kfold", seed, 0, F.col(group_col))).withColumn(
        "_prefix", F.substring("h", 1, PREFIX_DIGITS)
    )
    per_bucket = drawn.groupBy("size", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("size").orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = per_bucket.select("size", "_prefix", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy("size", "_prefix").orderBy("h")) - 1
    ranked = drawn.join(offsets, ["size", "_prefix"]).withColumn("_rank", rank)
    fold = F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))) + 1
    # One row per distinct size, at most sqrt(2N) of them: the optimizer broadcasts it by its size, or does not.
    return ranked.join(dealt, "size").select(group_col, "size", fold.alias("fold"))


def fold_roles(folds: DataFrame, n_folds: int, group_col: str = "group_key") -> DataFrame:
    """Folds as ``(split_id, group_key, role)``: fold i is the test side of split i."""
    splits = folds.select(group_col, "fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("split_id"))
    role = F.when(F.col("fold") == F.col("split_id"), F.lit("test")).otherwise(F.lit("train"))
    return splits.select("split_id", group_col, role.alias("role"))


def assign_roles(rows: DataFrame, roles: DataFrame, group_col: str = "group_key") -> DataFrame:
    """Rows repeated per split with their role.

    The join strategy is left to the optimizer: small role tables are broadcast by size, and a
    hot group is split by the adaptive skew join.
    """
    return rows.join(roles, group_col)


def class_shares(assigned: DataFrame, label_col: str = "label", weight_col: str | None = None) -> DataFrame:
    """``(split_id, role, label, n, share)``: class shares of train and test per split."""
    weight = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    counts = assigned.groupBy("split_id", "role", label_col).agg(weight.cast("bigint").alias("n"))
    side = W.partitionBy("split_id", "role")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(side))
