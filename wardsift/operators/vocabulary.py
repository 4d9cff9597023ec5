"""Token counts, rankings and log-odds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import MODALS, NEGATIONS, tokens, vocabulary_count
from .distribution import describe


def token_counts(df: DataFrame, by: Sequence[str], text_col: str = "report_text") -> DataFrame:
    """``(by..., token, n)``: counted before the shuffle, so a hot token costs one row per task."""
    return (
        df.select(*by, F.explode(tokens(text_col)).alias("token"))
        .groupBy(*by, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_tokens(df: DataFrame, by: Sequence[str], k: int = 20, text_col: str = "report_text") -> DataFrame:
    """The ``k`` most frequent tokens per group; ties by token.

    The rank filter is pushed below the shuffle, so at most ``k`` tokens per group leave a task.
    """
    order = W.partitionBy(*by).orderBy(F.col("n").desc(), F.col("token"))
    return token_counts(df, by, text_col).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_length_describe(df: DataFrame, by: Sequence[str] = (), text_col: str = "report_text") -> DataFrame:
    """Describe the number of tokens per text."""
    return describe(df.select(*by, F.size(tokens(text_col)).alias("n_tokens")), ["n_tokens"], by)


def log_odds(
    df: DataFrame,
    side: Column,
    within: Sequence[str] = (),
    alpha: float = 1.0,
    text_col: str = "report_text",
) -> DataFrame:
    """Log-odds of each token between two classes of texts, optionally inside each ``within`` group.

    ``side`` is true for the first class, false for the second and null for texts to leave out.
    One shuffle by token with two conditional counts replaces the join of two vocabularies.
    """
    sided = df.withColumn("_side", side).filter(F.col("_side").isNotNull())
    counts = (
        sided.select(*within, "_side", F.explode(tokens(text_col)).alias("token"))
        .groupBy(*within, "token")
        .agg(F.count_if("_side").alias("n_first"), F.count_if(~F.col("_side")).alias("n_second"))
    )
    sums = [F.sum("n_first").alias("_t1"), F.sum("n_second").alias("_t2")]
    if within:
        joined = counts.join(counts.groupBy(*within).agg(*sums), list(within))
    else:
        totals = counts.agg(F.struct(*sums)).scalar()
        joined = counts.withColumns({"_t1": totals["_t1"], "_t2": totals["_t2"]})
    first = (F.col("n_first") + F.lit(alpha)) / (F.col("_t1") + F.lit(alpha))
    second = (F.col("n_second") + F.lit(alpha)) / (F.col("_t2") + F.lit(alpha))
    return joined.select(*within, "token", "n_first", "n_second", F.log(first / second).alias("log_odds"))


def extreme_log_odds(scores: DataFrame, k: int = 15, within: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """``k`` highest and ``k`` lowest log-odds (per ``within`` group); ties by token.

    Scores are rounded before ranking, so the order does not hang on the last bit.
    """
    rounded = scores.withColumn("log_odds", F.round("log_odds", digits))
    sides = {"top": F.col("log_odds").desc(), "bottom": F.col("log_odds").asc()}
    out = None
    for name, order in sides.items():
        if within:
            ranked = rounded.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(order, "token")))
            part = ranked.filter(F.col("rank") <= k)
        else:
            # A plain sort with limit keeps k rows per task; the rank is then set on k rows.
            part = rounded.orderBy(order, "token").limit(k)
            part = part.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(name)).orderBy(order, "token")))
        part = part.withColumn("side", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def with_marker_counts(
    df: DataFrame,
    text_col: str = "report_text",
    negations: Sequence[str] = NEGATIONS,
    modals: Sequence[str] = MODALS,
) -> DataFrame:
    """Add ``n_negations`` and ``n_modals``."""
    toks = df.withColumn("_tokens", tokens(text_col))
    return toks.withColumns(
        {"n_negations": vocabulary_count("_tokens", negations), "n_modals": vocabulary_count("_tokens", modals)}
    ).drop("_tokens")
