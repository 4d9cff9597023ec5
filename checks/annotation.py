r"""Annotation path queries: keys, cache probe, batches, normalised records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.functions.signals import list_size, parse_list_text
from wardsift.operators.annotation import (
    annotate,
    attach_truth,
    normalize_responses,
    per_batch,
    per_text,
    probe_cache,
    build_requests,
    request_body,
    split_quarantine,
    unpack_responses,
    value_rules,
    with_cache_key,
)

from wardsift.plans.escalate import ALLOWED_VALUES, PROMPT as PROMPT_TEXT
from wardsift.schemas import RESPONSE_TEXT

from .registry import query
from .views import SQL_DOCS, SQL_SIGNALS, docs, raw_responses, reports, signals

RECORD_SCHEMA = RESPONSE_TEXT.simpleString()
PROMPT, NAMESPACE = "Assess the report. ", "escalation_check"

SQL_KEYED = f"""keyed AS (SELECT *, sha256('{PROMPT}' || report_text || '{NAMESPACE}') AS cache_key FROM docs)"""

SQL_NORMALIZED = """faulty AS (SELECT *, case_id % 10 AS fault FROM signals),
normalized AS (
  SELECT case_id, domain, clarity,
    CASE WHEN fault = 2 THEN false ELSE expected_action_llm END AS expected_action_llm,
    CASE WHEN fault = 0 THEN 'unknown' ELSE severity END AS severity,
    CASE WHEN fault = 3 AND n_risk_factors < 2 THEN [] ELSE risk_factors END AS risk_factors,
    uncertainty_level, missing_information,
    CASE WHEN fault = 1 THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence,
    confidence_derived
  FROM faulty WHERE fault NOT IN (4, 5))"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.concat_ws("|", c) for c in ("risk_factors", "missing_information")})


@query(
    "signals_normalized",
    f"""WITH {SQL_SIGNALS}, {SQL_NORMALIZED}
SELECT case_id, domain, clarity, expected_action_llm, severity, array_to_string(risk_factors, '|') AS risk_factors, uncertainty_level,
       array_to_string(missing_information, '|') AS missing_information, confidence, confidence_derived,
       CAST(len(risk_factors) AS BIGINT) AS n_risk_factors, CAST(len(missing_information) AS BIGINT) AS n_missing_information
FROM normalized""",
)
def signals_normalized(spark: SparkSession, sf: str) -> DataFrame:
    usable, _ = split_quarantine(normalize_responses(raw_responses(spark, sf)))
    return _flat(usable).drop("raw_json")


@query(
    "signals_quarantined",
    f"""WITH {SQL_DOCS}
SELECT case_id, CASE case_id % 10 WHEN 4 THEN 'broken_json' ELSE 'bad_action' END AS quarantine_reason
FROM docs WHERE case_id % 10 IN (4, 5)""",
)
def signals_quarantined(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = split_quarantine(normalize_responses(raw_responses(spark, sf)))
    return bad.select("case_id", "quarantine_reason")


@query(
    "signals_with_truth",
    f"""WITH {SQL_SIGNALS}, {SQL_NORMALIZED}
SELECT case_id, severity, confidence, expected_action, normalized.clarity, normalized.domain FROM normalized JOIN truth USING (case_id)""",
)
def signals_with_truth(spark: SparkSession, sf: str) -> DataFrame:
    usable, _ = split_quarantine(normalize_responses(raw_responses(spark, sf)))
    return attach_truth(usable.select("case_id", "severity", "confidence"), reports(spark, sf))


@query(
    "value_rules",
    f"""WITH {SQL_SIGNALS}, {SQL_NORMALIZED}
SELECT case_id, concat_ws('|', CASE WHEN severity NOT IN ('low', 'medium', 'high') THEN 'severity' END,
  CASE WHEN len(missing_information) > 0 AND confidence >= 0.5 THEN 'confidence_with_missing_information' END) AS violations
FROM normalized""",
)
def value_rules_query(spark: SparkSession, sf: str) -> DataFrame:
    usable, _ = split_quarantine(normalize_responses(raw_responses(spark, sf)))
    return value_rules(usable).select("case_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "list_parse",
    f"""WITH {SQL_SIGNALS}, forms AS (SELECT case_id, case_id % 6 AS form, risk_factors AS l FROM signals),
parsed AS (SELECT case_id, CASE WHEN form IN (0, 1) THEN l WHEN form = 5 THEN l || ['say None, ', NULL, 'True'] WHEN form = 2 AND len(l) >= 2 THEN l ELSE [] END AS l FROM forms)
SELECT case_id, array_to_string(l, '|') AS parsed, CAST(len(l) AS BIGINT) AS n FROM parsed""",
)
def list_parse(spark: SparkSession, sf: str) -> DataFrame:
    """List texts as single-quoted literal, JSON, comma text, broken literal, blank, literal with constants."""
    form, items = F.col("case_id") % 6, F.col("risk_factors")
    quoted = F.transform(items, lambda i: F.concat(F.lit("'"), i, F.lit("'")))
    text = (
        F.when(form == 0, F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]")))
        .when(form == 1, F.to_json(items))
        .when(form == 2, F.concat_ws(" , ", items))
        .when(form == 3, F.concat(F.lit("["), F.concat_ws(" ", quoted)))
        .when(form == 5, F.concat(F.lit("["), F.concat_ws(", ", F.concat(quoted, F.array(F.lit("'say None, ', None, True")))), F.lit("]")))
        .otherwise(F.lit("   "))
    )
    parsed = signals(spark, sf).select("case_id", text.alias("t")).withColumn("l", parse_list_text("t"))
    return parsed.select("case_id", F.concat_ws("|", "l").alias("parsed"), list_size("l").alias("n"))


@query("cache_keys", f"WITH {SQL_DOCS}, {SQL_KEYED} SELECT case_id, cache_key FROM keyed")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    return with_cache_key(docs(spark, sf), PROMPT, NAMESPACE).select("case_id", "cache_key")


def _probe(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Probe all documents against a cache that holds the texts of the clear ones."""
    keyed = with_cache_key(docs(spark, sf), PROMPT, NAMESPACE)
    cache = keyed.filter(F.col("clarity") == "clear").select(
        "cache_key", F.concat(F.lit('{"n": '), F.length("report_text").cast("string"), F.lit("}")).alias("raw_json")
    )
    return probe_cache(keyed, cache)


SQL_CACHE = """cached AS (SELECT DISTINCT cache_key FROM keyed WHERE clarity = 'clear'),
misses AS (SELECT cache_key, min(report_text) AS report_text FROM keyed
           WHERE cache_key NOT IN (SELECT cache_key FROM cached) GROUP BY cache_key)"""


@query(
    "cache_hit_miss",
    f"""WITH {SQL_DOCS}, {SQL_KEYED}, {SQL_CACHE}
SELECT 'hit' AS status, case_id, cache_key, CAST(length(report_text) AS BIGINT) AS n FROM keyed WHERE cache_key IN (SELECT cache_key FROM cached)
UNION ALL SELECT 'miss', NULL, cache_key, CAST(length(report_text) AS BIGINT) FROM misses""",
)
def cache_hit_miss(spark: SparkSession, sf: str) -> DataFrame:
    hits, misses = _probe(spark, sf)
    stored = F.get_json_object("raw_json", "$.n").cast("bigint")
    return hits.select(F.lit("hit").alias("status"), "case_id", "cache_key", stored.alias("n")).unionByName(
        misses.select(
            F.lit("miss").alias("status"),
            F.lit(None).cast("bigint").alias("case_id"),
            "cache_key",
            F.length("report_text").cast("bigint").alias("n"),
        )
    )


SQL_NUMBERED = """numbered AS (SELECT *, row_number() OVER (ORDER BY cache_key) - 1 AS rn FROM misses),
batched AS (SELECT *, rn // 5 AS batch, rn % 5 AS pos FROM numbered)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    _, misses = _probe(spark, sf)
    return build_requests(misses)


@query(
    "batch_requests",
    f"""WITH {SQL_DOCS}, {SQL_KEYED}, {SQL_CACHE}, {SQL_NUMBERED}
SELECT batch, count(*) AS n, string_agg(cache_key, ',' ORDER BY pos) AS cache_keys,
       CAST(sum(length(report_text)) AS BIGINT) AS n_chars FROM batched GROUP BY batch""",
)
def batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    items = F.from_json("texts_json", "array<struct<id: int, text: string>>")
    chars = F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, i: acc + F.length(i["text"]))
    return _requests(spark, sf).select(
        "batch",
        F.size("cache_keys").alias("n"),
        F.concat_ws(",", "cache_keys").alias("cache_keys"),
        chars.alias("n_chars"),
    )


@query(
    "batch_request_bodies",
    f"""WITH {SQL_DOCS}, {SQL_KEYED}, {SQL_CACHE}, {SQL_NUMBERED},
items AS (SELECT batch, to_json(list({{'id': pos, 'text': report_text}} ORDER BY pos)) AS texts FROM batched GROUP BY batch)
SELECT batch, sha256(concat_ws(chr(10), '{{0}}', 'JSON schema:', '{{1}}', '{{2}}', 'Reports:', texts)) AS request_sha FROM items""".replace(
        "{0}", PROMPT_TEXT.replace("'", "''")
    ).replace("{1}", RECORD_SCHEMA.replace("'", "''")).replace("{2}", ALLOWED_VALUES.replace("'", "''")),
)
def batch_request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Whole requests: instructions, record schema, allowed values and the texts of a batch."""
    whole = request_body(_requests(spark, sf), PROMPT_TEXT, RECORD_SCHEMA, ALLOWED_VALUES)
    return whole.select("batch", F.sha2("request", 256).alias("request_sha"))


@query(
    "batch_unpack",
    f"""WITH {SQL_DOCS}, {SQL_KEYED}, {SQL_CACHE}, {SQL_NUMBERED},
sized AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM batched)
SELECT cache_key, CASE WHEN batch % 7 = 6 OR (batch % 3 = 1 AND pos = n - 1) THEN NULL
                       ELSE '{{"n_chars":' || length(report_text) || '}}' END AS raw_json FROM sized""",
)
def batch_unpack(spark: SparkSession, sf: str) -> DataFrame:
    """Responses made from the requests; every third batch is one record short, every seventh is cut off."""
    requests = _requests(spark, sf)
    items = F.from_json("texts_json", "array<struct<id: int, text: string>>")
    records = F.transform(items, lambda i: F.struct(F.length(i["text"]).alias("n_chars")))
    kept = F.when(F.col("batch") % 3 == 1, F.slice(records, 1, F.size("cache_keys") - 1)).otherwise(records)
    whole = requests.withColumn("_json", F.to_json(kept))
    cut = F.when(F.col("batch") % 7 == 6, F.expr("substr(_json, 1, length(_json) - 3)")).otherwise(F.col("_json"))
    responses = whole.select("batch", cut.alias("raw_json"))
    return unpack_responses(requests, responses)


def _count_characters(text: str) -> str:
    return json.dumps({"n_chars": len(text), "upper": sum(c.isascii() and c.isupper() for c in text)})


def _count_characters_batch(texts: list[str]) -> list[str]:
    return [_count_characters(t) for t in texts]


SQL_ANNOTATED = f"""WITH {SQL_DOCS}, {SQL_KEYED}, {SQL_CACHE}
SELECT cache_key, CAST(length(report_text) AS BIGINT) AS n_chars,
       CAST(len(regexp_extract_all(report_text, '[A-Z]')) AS BIGINT) AS n_upper FROM misses"""


def _annotated(answers: DataFrame) -> DataFrame:
    return answers.select(
        "cache_key",
        F.get_json_object("raw_json", "$.n_chars").cast("bigint").alias("n_chars"),
        F.get_json_object("raw_json", "$.upper").cast("bigint").alias("n_upper"),
    )


@query("annotate_misses", SQL_ANNOTATED)
def annotate_misses(spark: SparkSession, sf: str) -> DataFrame:
    _, misses = _probe(spark, sf)
    return _annotated(annotate(misses, per_text(_count_characters)))


@query("annotate_misses_batch", SQL_ANNOTATED)
def annotate_misses_batch(spark: SparkSession, sf: str) -> DataFrame:
    _, misses = _probe(spark, sf)
    return _annotated(annotate(misses, per_batch(_count_characters_batch)))
