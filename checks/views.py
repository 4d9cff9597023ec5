r"""Views over the test tables, in Spark and as SQL.

``docs`` gives documents the columns of a report table; ``truth`` is the label; ``signals`` is a
deterministic stand-in for an annotator, computed from each whole text.  Text-derived columns are
computed on narrow rows before the label join, so the join never moves texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardsift.functions.signals import confidence_derived
from wardsift.functions.text import has_digit, words
from wardsift.operators.frames import compute_once

LEXICON = {
    "abuse": ["trash", "idiot", "clown", "scum", "worthless"],
    "insult": ["moron", "pathetic", "loser", "disgusting", "stupid"],
}
LEXICON_WORDS = sorted(w for ws in LEXICON.values() for w in ws)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    clarity = F.when(F.substring("source", 4, 10).cast("int") % 2 == 0, F.lit("clear")).otherwise(F.lit("ambiguous"))
    table = spark.read.parquet(f"{sf}/documents.parquet")
    return table.select(
        F.col("doc_id").alias("case_id"),
        F.col("text").alias("report_text"),
        F.col("lang").alias("domain"),
        clarity.alias("clarity"),
        "source",
    )


def truth(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.col("toxic") == 1, F.lit("escalation")).otherwise(F.lit("no_escalation"))
    return spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("case_id"), action.alias("expected_action")
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(truth(spark, sf), "case_id")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("report_text")
    base = compute_once(docs(spark, sf), {"_words": words(text), "_digit": has_digit(text)}).drop("report_text")
    lexicon = F.array(*[F.lit(w) for w in LEXICON_WORDS])
    base = compute_once(
        base, {"n_words": F.size("_words"), "risk_factors": F.array_intersect(lexicon, "_words")}
    ).drop("_words")
    missing = F.array_compact(
        F.array(
            F.when(~F.col("_digit"), F.lit("no_digits")),
            F.when(F.col("n_words") < 100, F.lit("short")),
            F.when(F.col("domain") != "en", F.lit("foreign")),
        )
    )
    sized = base.withColumn("missing_information", missing).withColumns(
        {"n_risk_factors": F.size("risk_factors"), "n_missing_information": F.size("missing_information")}
    )
    rf, mi = F.col("n_risk_factors"), F.col("n_missing_information")
    return sized.withColumns(
        {
            "severity": F.when(rf >= 3, F.lit("high"))
            .when((rf >= 1) | (F.col("n_words") >= 600), F.lit("medium"))
            .otherwise(F.lit("low")),
            "uncertainty_level": F.when(mi == 0, F.lit("low")).when(mi == 1, F.lit("medium")).otherwise(F.lit("high")),
            "confidence": F.when(mi == 0, F.lit(0.9)).when(mi == 1, F.lit(0.7)).when(mi == 2, F.lit(0.5)).otherwise(F.lit(0.3)),
            "expected_action_llm": (rf >= 2) | (F.col("n_words") >= 200),
        }
    ).withColumn("confidence_derived", confidence_derived("uncertainty_level")).drop("_digit")


def labelled_signals(spark: SparkSession, sf: str) -> DataFrame:
    return signals(spark, sf).join(truth(spark, sf), "case_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A rule-based score in steps of 0.01, so that it falls on sweep thresholds."""
    points = F.least(F.lit(100), F.lit(20) * F.col("n_risk_factors") + F.least(F.lit(40), F.floor(F.col("n_words") / 25)))
    return labelled_signals(spark, sf).select(
        "case_id",
        "domain",
        "source",
        (F.col("expected_action") == "escalation").cast("int").alias("label"),
        (points * F.lit(0.01)).alias("score"),
    )


def clean_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as JSON text."""
    return _responses(spark, sf, F.lit(9))


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as JSON text with faults planted by the last digit of the case id."""
    return _responses(spark, sf, F.col("case_id") % 10)


def _responses(spark: SparkSession, sf: str, fault: Column) -> DataFrame:
    action = F.when(F.col("expected_action_llm"), F.lit("true")).otherwise(F.lit("false"))
    fields = [
        F.concat(
            F.lit('"expected_action": '),
            F.when(fault == 2, F.lit('"false"')).when(fault == 5, F.lit('"maybe"')).otherwise(action),
        ),
        F.when(fault != 0, F.concat(F.lit('"severity": "'), F.col("severity"), F.lit('"'))),
        F.concat(
            F.lit('"risk_factors": '),
            F.when(fault == 3, F.concat(F.lit('"'), F.concat_ws(", ", "risk_factors"), F.lit('"'))).otherwise(
                F.to_json("risk_factors")
            ),
        ),
        F.concat(F.lit('"uncertainty_level": "'), F.col("uncertainty_level"), F.lit('"')),
        F.concat(F.lit('"missing_information": '), F.to_json("missing_information")),
        F.concat(F.lit('"confidence": '), F.when(fault == 1, F.lit("null")).otherwise(F.col("confidence").cast("string"))),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    raw = F.when(fault == 4, F.expr("substr(_body, 1, length(_body) - 12)")).otherwise(F.col("_body"))
    return signals(spark, sf).withColumn("_body", body).select("case_id", "domain", "clarity", raw.alias("raw_json"))


_LEX_SQL = "[" + ", ".join(f"'{w}'" for w in LEXICON_WORDS) + "]"

SQL_DOCS = r"""docs AS (
  SELECT doc_id AS case_id, text AS report_text, lang AS domain,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'clear' ELSE 'ambiguous' END AS clarity, source
  FROM documents)"""

SQL_TRUTH = """truth AS (
  SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 'escalation' ELSE 'no_escalation' END AS expected_action
  FROM labels)"""

SQL_REPORTS = f"""{SQL_DOCS}, {SQL_TRUTH}, reports AS (SELECT * FROM docs JOIN truth USING (case_id))"""

SQL_SIGNALS = rf"""{SQL_DOCS}, {SQL_TRUTH}, worded AS (
  SELECT *, regexp_extract_all(lower(report_text), '[\p{{L}}\p{{N}}_]+') AS w FROM docs),
base AS (
  SELECT case_id, domain, clarity, source, CAST(len(w) AS BIGINT) AS n_words,
         list_filter({_LEX_SQL}, lambda k: list_contains(w, k)) AS risk_factors,
         list_filter([CASE WHEN NOT regexp_matches(report_text, '\p{{Nd}}') THEN 'no_digits' END,
                      CASE WHEN len(w) < 100 THEN 'short' END,
                      CASE WHEN domain <> 'en' THEN 'foreign' END], lambda m: m IS NOT NULL) AS missing_information
  FROM worded),
sized AS (
  SELECT *, CAST(len(risk_factors) AS BIGINT) AS n_risk_factors,
         CAST(len(missing_information) AS BIGINT) AS n_missing_information FROM base),
signals AS (
  SELECT *,
    CASE WHEN n_risk_factors >= 3 THEN 'high' WHEN n_risk_factors >= 1 OR n_words >= 600 THEN 'medium' ELSE 'low' END AS severity,
    CASE n_missing_information WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS uncertainty_level,
    CAST(CASE n_missing_information WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence,
    CAST(CASE n_missing_information WHEN 0 THEN 0.85 WHEN 1 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS confidence_derived,
    (n_risk_factors >= 2 OR n_words >= 200) AS expected_action_llm
  FROM sized),
lsignals AS (SELECT * FROM signals JOIN truth USING (case_id)),
scored AS (
  SELECT case_id, domain, source, CAST(expected_action = 'escalation' AS INTEGER) AS label,
         least(100, 20 * n_risk_factors + least(40, n_words // 25)) * CAST(0.01 AS DOUBLE) AS score
  FROM lsignals)"""


def sql_decision(version: str) -> str:
    """Decision of a rule version as a SQL expression over the columns of ``signals``."""
    up = (
        "(severity = 'high' OR (severity = 'medium' AND (confidence >= 0.8 OR n_missing_information >= 2 OR n_risk_factors >= 2)))"
    )
    none_found = "severity = 'medium' AND n_risk_factors = 0 AND n_missing_information = 0"
    down = {
        "baseline": "false",
        "v2": "(severity = 'low' AND confidence < 0.4 AND uncertainty_level = 'high')",
        "v3": "(severity = 'low' AND confidence < 0.4 AND uncertainty_level = 'high')",
        "v4": "severity = 'low'",
        "v5": f"(severity = 'low' OR ({none_found} AND uncertainty_level = 'low'))",
        "v6": f"(severity = 'low' OR ({none_found} AND confidence >= 0.7))",
    }[version]
    raised = up if version in ("v4", "v5", "v6") else "false"
    return f"CASE WHEN expected_action_llm THEN NOT {down} ELSE {raised} END"
