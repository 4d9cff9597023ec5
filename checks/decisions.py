"""Rule and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.functions.labels import encode_label, encode_prediction
from wardsift.functions.rules import DECISION_RULES, RED_FLAGS
from wardsift.operators.decisions import (
    count_by,
    decide,
    disagreement,
    error_profile,
    errors,
    match_rules,
    rule_hits,
    scored_errors,
    with_label_texts,
)
from wardsift.operators.evaluation import confusion, with_binary_metrics
from wardsift.operators.frames import compare_runs, merge_runs
from wardsift.session import cut_lineage

from .registry import query
from .views import (
    LEXICON,
    SQL_DOCS,
    SQL_SIGNALS,
    SQL_TRUTH,
    docs,
    labelled_signals,
    scored,
    signals,
    sql_decision,
    truth,
)


def _sql_entries(dictionary: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{c}', '{k}')" for c, ks in dictionary.items() for k in ks)
    return f"dictionary(category, keyword) AS (VALUES {rows})"


SQL_WORDS = r"""worded AS (
  SELECT case_id, domain, list_distinct(regexp_extract_all(lower(report_text), '[\p{L}\p{N}_]+')) AS w FROM docs)"""


@query(
    "rule_hits",
    f"""WITH {SQL_DOCS}, {SQL_WORDS}, {_sql_entries(LEXICON)}
SELECT case_id, category, keyword FROM (SELECT case_id, unnest(w) AS keyword FROM worded) JOIN dictionary USING (keyword)""",
)
def rule_hits_query(spark: SparkSession, sf: str) -> DataFrame:
    return rule_hits(match_rules(docs(spark, sf), LEXICON), "case_id")


@query(
    "rule_hits_default_dictionary",
    f"""WITH {SQL_DOCS}, {SQL_WORDS}, {_sql_entries(RED_FLAGS)},
hits AS (SELECT DISTINCT case_id FROM (SELECT case_id, unnest(w) AS keyword FROM worded) JOIN dictionary USING (keyword))
SELECT domain, count(*) AS n_reports, count(hits.case_id) AS n_escalated FROM docs LEFT JOIN hits USING (case_id) GROUP BY domain""",
)
def rule_hits_default(spark: SparkSession, sf: str) -> DataFrame:
    matched = match_rules(docs(spark, sf))
    return matched.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_reports"), F.count_if("expected_action_rule").alias("n_escalated")
    )


@query(
    "rule_hits_prefix",
    rf"""WITH {SQL_DOCS}, {SQL_WORDS}, {_sql_entries(LEXICON)},
words AS (SELECT case_id, unnest(w) AS word FROM worded)
SELECT DISTINCT case_id, category, keyword FROM words JOIN dictionary ON starts_with(word, keyword)""",
)
def rule_hits_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return rule_hits(match_rules(docs(spark, sf), LEXICON, mode="prefix"), "case_id")


@query(
    "rule_confusion",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}, {SQL_WORDS}, {_sql_entries(LEXICON)},
hit AS (SELECT case_id, expected_action = 'escalation' AS y, len(list_filter(w, lambda x: x IN (SELECT keyword FROM dictionary))) > 0 AS p
        FROM worded JOIN truth USING (case_id))
SELECT count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (NOT y AND p) AS fp,
       count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (y AND p) AS tp FROM hit""".replace(
        "x IN (SELECT keyword FROM dictionary)",
        "list_contains([" + ", ".join(f"'{k}'" for ks in LEXICON.values() for k in ks) + "], x)",
    ),
)
def rule_confusion(spark: SparkSession, sf: str) -> DataFrame:
    matched = match_rules(docs(spark, sf), LEXICON).select("case_id", "expected_action_rule")
    encoded = matched.join(truth(spark, sf), "case_id").select(
        encode_label("expected_action").alias("label"), encode_prediction("expected_action_rule").alias("prediction")
    )
    return confusion(encoded)


def _decide_query(version: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        decided = decide(signals(spark, sf), version)
        return decided.select("case_id", "rule_version", "expected_action_llm", "expected_action_final")

    return run


for _version in DECISION_RULES:
    query(
        f"decide_{_version}",
        f"""WITH {SQL_SIGNALS}
SELECT case_id, '{_version}' AS rule_version, expected_action_llm, {sql_decision(_version)} AS expected_action_final FROM signals""",
    )(_decide_query(_version))

RUN_VERSIONS = ("baseline", "v2", "v4", "v6")
KEYS = ["case_id", "domain", "clarity"]


def _runs(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Runs are stored tables: the signals behind them are written once."""
    base = cut_lineage(labelled_signals(spark, sf))
    return {
        v: decide(base, v).select(*KEYS, "expected_action", "severity", F.col("expected_action_final").alias("pred"))
        for v in RUN_VERSIONS
    }


SQL_RUNS = ", ".join(f"{sql_decision(v)} AS pred_{i}" for i, v in enumerate(RUN_VERSIONS))


@query(
    "run_merge",
    f"""WITH {SQL_SIGNALS}
SELECT case_id, domain, clarity, {SQL_RUNS},
       {", ".join(f"expected_action AS expected_action_{i}" for i in range(len(RUN_VERSIONS)))} FROM lsignals""",
)
def run_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge_runs(list(_runs(spark, sf).values()), KEYS, drop=["severity"])


SQL_NAMED_RUNS = ", ".join(f"{sql_decision(v)} AS pred_{v}" for v in RUN_VERSIONS)


@query(
    "run_agreement",
    f"""WITH {SQL_SIGNALS}, runs AS (SELECT domain, clarity, {SQL_NAMED_RUNS} FROM lsignals)
SELECT domain, clarity, {", ".join(f"pred_{v}" for v in RUN_VERSIONS)}, count(*) AS n FROM runs GROUP BY ALL""",
)
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    side_by_side = compare_runs(_runs(spark, sf), KEYS, "pred")
    return count_by(side_by_side, ["domain", "clarity", *[f"pred_{v}" for v in RUN_VERSIONS]])


@query(
    "run_disagreement",
    f"""WITH {SQL_SIGNALS}, runs AS (SELECT case_id, domain, clarity, expected_action,
  CASE WHEN {sql_decision("v6")} THEN 'escalation' ELSE 'no_escalation' END AS pred FROM lsignals)
SELECT case_id, domain, clarity, expected_action, pred FROM runs WHERE expected_action <> pred""",
)
def run_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    run = with_label_texts(_runs(spark, sf)["v6"], ["pred"])
    return disagreement(run, "expected_action", "pred", [*KEYS, "expected_action", "pred"])


@query(
    "label_distribution",
    f"""WITH {SQL_DOCS}, {SQL_TRUTH}
SELECT domain, clarity, expected_action, count(*) AS n FROM docs JOIN truth USING (case_id) GROUP BY ALL""",
)
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return count_by(docs(spark, sf).join(truth(spark, sf), "case_id"), ["domain", "clarity", "expected_action"])


SQL_WRONG = f"""decided AS (SELECT *, {sql_decision("v6")} AS final FROM lsignals),
wrong AS (SELECT *, CASE WHEN final THEN 'false_positive' ELSE 'false_negative' END AS error_type
          FROM decided WHERE (expected_action = 'escalation') <> final)"""


@query(
    "errors_fn_fp",
    f"""WITH {SQL_SIGNALS}, {SQL_WRONG}
SELECT case_id, domain, clarity, severity, expected_action,
       CASE WHEN final THEN 'escalation' ELSE 'no_escalation' END AS expected_action_final, error_type FROM wrong""",
)
def errors_fn_fp(spark: SparkSession, sf: str) -> DataFrame:
    wrong = errors(decide(labelled_signals(spark, sf), "v6"), "expected_action_final")
    return with_label_texts(wrong, ["expected_action_final"]).select(
        "case_id", "domain", "clarity", "severity", "expected_action", "expected_action_final", "error_type"
    )


@query(
    "error_profile",
    f"""WITH {SQL_SIGNALS}, {SQL_WRONG}
SELECT error_type, domain, clarity, n_risk_factors, n_missing_information, severity, confidence, uncertainty_level,
       confidence_derived, count(*) AS n FROM wrong GROUP BY ALL""",
)
def error_profile_query(spark: SparkSession, sf: str) -> DataFrame:
    return error_profile(errors(decide(labelled_signals(spark, sf), "v6"), "expected_action_final"))


@query(
    "scored_errors",
    f"""WITH {SQL_SIGNALS}
SELECT case_id, CASE WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_type
FROM scored WHERE label <> CAST(score >= CAST(0.3 AS DOUBLE) AS INTEGER)""",
)
def scored_errors_query(spark: SparkSession, sf: str) -> DataFrame:
    decided = scored(spark, sf).withColumn("prediction", (F.col("score") >= F.lit(0.3)).cast("int"))
    return scored_errors(decided, key="case_id")


@query(
    "triage_quality_by_domain",
    f"""WITH {SQL_SIGNALS}, decided AS (SELECT domain, expected_action = 'escalation' AS y, {sql_decision("v6")} AS p FROM lsignals),
c AS (SELECT domain, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (NOT y AND p) AS fp,
             count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (y AND p) AS tp FROM decided GROUP BY domain)
SELECT domain, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), 6) AS f1,
       round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2 FROM c""",
)
def triage_quality_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    from wardsift.operators.annotation import normalize_responses, split_quarantine

    from .views import clean_responses

    usable, _ = split_quarantine(normalize_responses(clean_responses(spark, sf)))
    decided = decide(usable, "v6").join(truth(spark, sf), "case_id")
    encoded = decided.select(
        "domain",
        encode_label("expected_action").alias("label"),
        encode_prediction("expected_action_final").alias("prediction"),
    )
    quality = with_binary_metrics(confusion(encoded, ["domain"]))
    return quality.select(
        "domain", "tn", "fp", "fn", "tp", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1", "f2")]
    )
