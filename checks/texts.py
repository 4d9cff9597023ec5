r"""Text profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.functions.text import METRICS, text_hash, tokens
from wardsift.operators.distribution import describe, describe_levels
from wardsift.operators.profile import (
    duplicate_rate,
    extreme_flags,
    extreme_rates,
    sample_heads,
    sanity_profile,
    with_text_metrics,
)
from wardsift.operators.vocabulary import (
    extreme_log_odds,
    log_odds,
    token_length_describe,
    top_tokens,
    with_marker_counts,
)
from wardsift.session import cut_lineage

from .registry import query
from .views import SQL_DOCS, SQL_TRUTH, docs, reports, truth

SQL_METRICS = r"""counted AS (
  SELECT case_id, domain, clarity, source,
    CAST(length(report_text) AS BIGINT) AS n_chars,
    CAST(len(regexp_extract_all(report_text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words,
    CAST(len(regexp_extract_all(report_text, '[.!?]+')) AS BIGINT) AS n_sentences,
    CAST(len(regexp_extract_all(report_text, '\p{Nd}')) AS BIGINT) AS n_digits,
    CAST(len(regexp_extract_all(report_text, '[A-ZÄÖÜ]')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(report_text, '[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]')) AS BIGINT) AS n_punct
  FROM docs),
metrics AS (
  SELECT *, CASE WHEN n_chars > 0 THEN n_digits / n_chars ELSE 0.0 END AS digit_ratio,
            CASE WHEN n_chars > 0 THEN n_upper / n_chars ELSE 0.0 END AS upper_ratio,
            CASE WHEN n_chars > 0 THEN n_punct / n_chars ELSE 0.0 END AS punct_ratio
  FROM counted)"""

SQL_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT case_id, domain, clarity, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM metrics" for m in METRICS
) + ")"

SQL_TOKENS = r"""tokened AS (
  SELECT docs.*, list_filter(regexp_extract_all(lower(report_text), '[\p{L}\p{N}_]+'),
                             lambda t: regexp_full_match(t, '[a-z]{2,}')) AS tokens FROM docs)"""


def sql_describe(probs: dict[str, float], digits: int = 3) -> str:
    quantiles = ", ".join(f"round(quantile_cont(value, {p}), {digits}) AS {name}" for name, p in probs.items())
    return (
        f"count(value) AS count, round(avg(value), {digits}) AS mean, round(stddev_samp(value), {digits}) AS std, "
        f"round(min(value), {digits}) AS min, {quantiles}, round(max(value), {digits}) AS max"
    )


QUARTILE_SQL = sql_describe({"p25": 0.25, "p50": 0.5, "p75": 0.75})
TAIL_SQL = sql_describe({"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return with_text_metrics(docs(spark, sf)).drop("report_text")


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths only; written once, because flags and their threshold both need them."""
    measured = with_text_metrics(docs(spark, sf), metrics=["n_chars", "n_words"])
    return cut_lineage(measured.select("case_id", "domain", "n_chars", "n_words"))


SQL_TRIM = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$"


@query(
    "text_metrics",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}
SELECT case_id, n_chars, n_words, n_sentences, n_digits, n_upper, n_punct,
       round(digit_ratio, 6) AS digit_ratio, round(upper_ratio, 6) AS upper_ratio, round(punct_ratio, 6) AS punct_ratio
FROM metrics""",
)
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ratios = [F.round(m, 6).alias(m) if m.endswith("ratio") else F.col(m) for m in METRICS]
    return _measured(spark, sf).select("case_id", *ratios)


@query(
    "text_describe",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}, {SQL_LONG}
SELECT metric, {QUARTILE_SQL} FROM long GROUP BY metric""",
)
def text_describe(spark: SparkSession, sf: str) -> DataFrame:
    return describe(_measured(spark, sf), METRICS)


@query(
    "text_describe_by_lang",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}, {SQL_LONG}
SELECT domain, metric, {QUARTILE_SQL} FROM long GROUP BY domain, metric""",
)
def text_describe_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return describe(_measured(spark, sf), METRICS, ["domain"])


@query(
    "text_tail_describe",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}, {SQL_METRICS}, {SQL_LONG}, labelled AS (SELECT * FROM long JOIN truth USING (case_id))
SELECT 'overall' AS level, NULL AS expected_action, NULL AS domain, metric, {TAIL_SQL} FROM labelled GROUP BY metric
UNION ALL
SELECT 'expected_action', expected_action, NULL, metric, {TAIL_SQL} FROM labelled GROUP BY expected_action, metric
UNION ALL
SELECT 'domain', NULL, domain, metric, {TAIL_SQL} FROM labelled GROUP BY domain, metric""",
)
def text_tail_describe(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _measured(spark, sf).join(truth(spark, sf), "case_id")
    return describe_levels(labelled, METRICS, [[], ["expected_action"], ["domain"]])


@query(
    "extreme_rates",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}, cut AS (SELECT quantile_cont(n_words, 0.99) AS q FROM metrics)
SELECT round(avg(CAST(n_chars = 0 AS INTEGER)), 6) AS rate_empty, round(avg(CAST(n_words <= 3 AS INTEGER)), 6) AS rate_tiny,
       round(avg(CAST(n_words >= q AS INTEGER)), 6) AS rate_huge FROM metrics, cut""",
)
def extreme_rates_query(spark: SparkSession, sf: str) -> DataFrame:
    rates = extreme_rates(with_text_metrics(docs(spark, sf), metrics=["n_chars", "n_words"]))
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


@query(
    "extreme_flags",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}, cut AS (SELECT quantile_cont(n_words, 0.99) AS q FROM metrics)
SELECT case_id, n_words, n_chars = 0 AS is_empty, n_words <= 3 AS is_tiny, n_words >= q AS is_huge FROM metrics, cut""",
)
def extreme_flags_query(spark: SparkSession, sf: str) -> DataFrame:
    flagged = extreme_flags(_lengths(spark, sf))
    return flagged.select("case_id", "n_words", "is_empty", "is_tiny", "is_huge")


@query(
    "extreme_samples",
    f"""WITH {SQL_DOCS}, {SQL_METRICS}, cut AS (SELECT quantile_cont(n_words, 0.99) AS q FROM metrics)
SELECT * FROM (SELECT 'is_empty' AS flag, case_id, domain FROM metrics WHERE n_chars = 0 ORDER BY case_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'is_tiny' AS flag, case_id, domain FROM metrics WHERE n_words <= 3 ORDER BY case_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'is_huge' AS flag, case_id, domain FROM metrics, cut WHERE n_words >= q ORDER BY case_id LIMIT 3)""",
)
def extreme_samples(spark: SparkSession, sf: str) -> DataFrame:
    flagged = extreme_flags(_lengths(spark, sf))
    return sample_heads(flagged, {"is_empty": 10, "is_tiny": 10, "is_huge": 3}, ["domain"])


@query(
    "sanity_profile",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}, all_docs AS (SELECT * FROM docs LEFT JOIN truth USING (case_id)),
shares AS (SELECT avg(CAST(report_text IS NULL AS INTEGER)) AS a, avg(CAST(length(report_text) = 0 AS INTEGER)) AS b FROM all_docs)
SELECT expected_action, count(*) AS n_label, any_value(a) AS mean_null_text, any_value(b) AS mean_empty_text
FROM all_docs, shares GROUP BY expected_action""",
)
def sanity(spark: SparkSession, sf: str) -> DataFrame:
    return sanity_profile(docs(spark, sf).join(truth(spark, sf), "case_id", "left"))


@query(
    "text_hashes",
    rf"""WITH {SQL_DOCS}
SELECT case_id, sha256(regexp_replace(lower(report_text), '{SQL_TRIM}', '', 'g')) AS text_hash FROM docs""",
)
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth text gets white space beyond ASCII around it, which does not change its hash."""
    padded = F.when(F.col("case_id") % 4 == 0, F.concat(F.lit("  "), "report_text", F.lit("  "))).otherwise(F.col("report_text"))
    return docs(spark, sf).select("case_id", text_hash(padded).alias("text_hash"))


@query(
    "duplicate_rate",
    rf"""WITH {SQL_DOCS}, hashed AS (SELECT sha256(regexp_replace(lower(report_text), '{SQL_TRIM}', '', 'g')) AS h FROM docs)
SELECT count(*) AS n_rows, count(DISTINCT h) AS n_distinct, round(1 - count(DISTINCT h) / count(*), 6) AS duplicate_rate FROM hashed""",
)
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_rate(docs(spark, sf)).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query(
    "token_lists",
    f"""WITH {SQL_DOCS}, {SQL_TOKENS}
SELECT case_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tokened""",
)
def token_lists(spark: SparkSession, sf: str) -> DataFrame:
    toks = docs(spark, sf).select("case_id", tokens("report_text").alias("t"))
    return toks.select("case_id", F.size("t").alias("n_tokens"), F.concat_ws(" ", "t").alias("tokens"))


@query(
    "token_length_describe",
    f"""WITH {SQL_DOCS}, {SQL_TOKENS}, lengths AS (SELECT domain, clarity, CAST(len(tokens) AS DOUBLE) AS value FROM tokened)
SELECT domain, clarity, 'n_tokens' AS metric, {QUARTILE_SQL} FROM lengths GROUP BY domain, clarity""",
)
def token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return token_length_describe(docs(spark, sf), ["domain", "clarity"])


def _sql_top(source: str, by: str) -> str:
    return f"""counts AS (SELECT {by}, token, count(*) AS n FROM (SELECT {by}, unnest(tokens) AS token FROM {source}) GROUP BY {by}, token),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, token) AS rank FROM counts)
SELECT {by}, token, n, rank FROM ranked WHERE rank <= 20"""


@query("top_tokens_by_group", f"WITH {SQL_DOCS}, {SQL_TOKENS}, " + _sql_top("tokened", "domain, clarity"))
def top_tokens_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return top_tokens(docs(spark, sf), ["domain", "clarity"])


@query(
    "top_tokens_by_label",
    f"WITH {SQL_DOCS}, {SQL_TRUTH}, {SQL_TOKENS}, labelled AS (SELECT * FROM tokened JOIN truth USING (case_id)), "
    + _sql_top("labelled", "expected_action"),
)
def top_tokens_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return top_tokens(reports(spark, sf), ["expected_action"])


@query(
    "log_odds_label",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}, {SQL_TOKENS}, labelled AS (SELECT * FROM tokened JOIN truth USING (case_id)),
exploded AS (SELECT expected_action = 'escalation' AS pos, unnest(tokens) AS token FROM labelled),
counts AS (SELECT token, CAST(sum(CAST(pos AS INTEGER)) AS BIGINT) AS n_first, CAST(sum(CAST(NOT pos AS INTEGER)) AS BIGINT) AS n_second
           FROM exploded GROUP BY token),
totals AS (SELECT sum(n_first) AS t1, sum(n_second) AS t2 FROM counts),
scores AS (SELECT token, n_first, n_second, round(ln(((n_first + 1.0) / (t1 + 1.0)) / ((n_second + 1.0) / (t2 + 1.0))), 6) AS log_odds
           FROM counts, totals)
SELECT * FROM (SELECT 'top' AS side, token, n_first, n_second, log_odds, row_number() OVER (ORDER BY log_odds DESC, token) AS rank FROM scores) WHERE rank <= 15
UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, token, n_first, n_second, log_odds, row_number() OVER (ORDER BY log_odds, token) AS rank FROM scores) WHERE rank <= 15""",
)
def log_odds_label(spark: SparkSession, sf: str) -> DataFrame:
    return extreme_log_odds(log_odds(reports(spark, sf), F.col("expected_action") == "escalation"))


@query(
    "log_odds_clarity",
    f"""WITH {SQL_DOCS}, {SQL_TOKENS},
exploded AS (SELECT domain, clarity = 'clear' AS pos, unnest(tokens) AS token FROM tokened),
counts AS (SELECT domain, token, CAST(sum(CAST(pos AS INTEGER)) AS BIGINT) AS n_first, CAST(sum(CAST(NOT pos AS INTEGER)) AS BIGINT) AS n_second
           FROM exploded GROUP BY domain, token),
totals AS (SELECT domain, sum(n_first) AS t1, sum(n_second) AS t2 FROM counts GROUP BY domain),
scores AS (SELECT domain, token, n_first, n_second, round(ln(((n_first + 1.0) / (t1 + 1.0)) / ((n_second + 1.0) / (t2 + 1.0))), 6) AS log_odds
           FROM counts JOIN totals USING (domain))
SELECT * FROM (SELECT 'top' AS side, domain, token, n_first, n_second, log_odds, row_number() OVER (PARTITION BY domain ORDER BY log_odds DESC, token) AS rank FROM scores) WHERE rank <= 15
UNION ALL
SELECT * FROM (SELECT 'bottom' AS side, domain, token, n_first, n_second, log_odds, row_number() OVER (PARTITION BY domain ORDER BY log_odds, token) AS rank FROM scores) WHERE rank <= 15""",
)
def log_odds_clarity(spark: SparkSession, sf: str) -> DataFrame:
    scores = log_odds(docs(spark, sf), F.col("clarity") == "clear", ["domain"])
    return extreme_log_odds(scores, within=["domain"])


MARKERS_A, MARKERS_B = ("the", "of", "and", "to", "in"), ("is", "was", "it", "that", "for")


@query(
    "marker_describe",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}, {SQL_TOKENS}, labelled AS (SELECT * FROM tokened JOIN truth USING (case_id)),
counted AS (SELECT expected_action,
  CAST(len(list_filter(tokens, lambda t: list_contains({list(MARKERS_A)}, t))) AS DOUBLE) AS n_negations,
  CAST(len(list_filter(tokens, lambda t: list_contains({list(MARKERS_B)}, t))) AS DOUBLE) AS n_modals FROM labelled),
long AS (SELECT expected_action, 'n_negations' AS metric, n_negations AS value FROM counted
         UNION ALL SELECT expected_action, 'n_modals', n_modals FROM counted)
SELECT expected_action, metric, {QUARTILE_SQL} FROM long GROUP BY expected_action, metric""",
)
def marker_describe(spark: SparkSession, sf: str) -> DataFrame:
    counted = with_marker_counts(docs(spark, sf), negations=MARKERS_A, modals=MARKERS_B).drop("report_text")
    return describe(counted.join(truth(spark, sf), "case_id"), ["n_negations", "n_modals"], ["expected_action"])
