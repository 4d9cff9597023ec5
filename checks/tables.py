"""Source, sink and integrity queries.

Files are written to a fresh folder below the session's checkpoint folder and read back, so the
queries work wherever executors share that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardsift.operators.frames import drop_columns, integrity, rename_by_split
from wardsift.schemas import LEDGER, REPORTS
from wardsift.session import ensure_checkpoint_dir
from wardsift.sources.reports import (
    decimal_comma,
    fix_single_column,
    read_csv,
    read_csv_dialect,
    read_folder,
    read_prepared,
    read_reports,
    read_runs,
    union_runs,
)
from wardsift.sources.quoted import read_quoted_csv
from wardsift.sources.tables import (
    append_cache,
    append_json,
    append_ledger,
    latest_runs,
    read_cache,
    read_json,
    read_ledger,
    restore_latest,
    write_once,
    write_result,
)
from wardsift.operators.annotation import latest_responses

from .registry import query
from .views import SQL_DOCS, SQL_REPORTS, SQL_SIGNALS, docs, labelled_signals, reports


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


@query(
    "integrity_checks",
    f"""WITH {SQL_REPORTS}
SELECT count(*) AS n_rows, count(*) - count(DISTINCT case_id) AS n_repeated_keys, count(*) FILTER (case_id IS NULL) AS n_all_null FROM reports""",
)
def integrity_checks(spark: SparkSession, sf: str) -> DataFrame:
    return integrity(reports(spark, sf), "case_id", ["report_text", "expected_action"])


@query(
    "integrity_of_copies",
    f"""WITH {SQL_DOCS}
SELECT count(*) AS n_rows, count(*) - count(DISTINCT report_text) AS n_repeated_keys, count(*) FILTER (report_text IS NULL) AS n_all_null FROM docs""",
)
def integrity_of_copies(spark: SparkSession, sf: str) -> DataFrame:
    return integrity(docs(spark, sf).select("report_text"), "report_text")


@query(
    "renamed_columns",
    f"WITH {SQL_DOCS} SELECT case_id, domain, clarity FROM docs",
)
def renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = docs(spark, sf).toDF("case_id run 1", "report_text", "domain x", "clarity", "source y")
    return drop_columns(rename_by_split(wide), ["report_text", "source", "not there"])


SQL_LINES = f"""{SQL_DOCS}, lines AS (SELECT case_id, domain, CASE WHEN case_id % 3 = 0 THEN NULL ELSE clarity END AS clarity FROM docs)"""


@query("single_column_fix", f"WITH {SQL_LINES} SELECT CAST(case_id AS VARCHAR) AS case_id, domain, clarity FROM lines")
def single_column_fix(spark: SparkSession, sf: str) -> DataFrame:
    """One text column with missing and surplus fields."""
    kind = F.col("case_id") % 3
    line = F.when(kind == 0, F.concat_ws(",", "case_id", "domain")).otherwise(
        F.when(kind == 1, F.concat_ws(",", "case_id", "domain", "clarity")).otherwise(
            F.concat_ws(",", "case_id", "domain", "clarity", F.lit("surplus"), F.lit(""))
        )
    )
    return fix_single_column(docs(spark, sf).select(line.alias("case_id, domain ,clarity")))


@query(
    "decimal_comma",
    f"""WITH {SQL_DOCS} SELECT case_id, CASE WHEN case_id % 4 = 3 THEN NULL ELSE CAST(case_id AS DOUBLE) / 4 END AS amount FROM docs""",
)
def decimal_comma_query(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_replace((F.col("case_id") / 4).cast("string"), "[.]", ",")
    text = F.when(F.col("case_id") % 4 == 3, F.lit("n/a")).otherwise(number)
    return decimal_comma(docs(spark, sf).select("case_id", text.alias("amount")), ["amount"])


@query(
    "reports_csv",
    f"""WITH {SQL_REPORTS} SELECT case_id, domain, clarity, expected_action, sha256(report_text) AS text_sha, NULL AS comment FROM reports""",
)
def reports_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, line breaks and quotes included, through a CSV file and the dataset registry."""
    path = _folder(spark)
    table = reports(spark, sf).withColumn("comment", F.lit(None).cast("string"))
    columns = ["case_id", "domain", "clarity", "expected_action", "report_text", "comment"]
    write_result(table.select(*columns), path, fmt="csv")
    back = read_reports(spark, "v2", {"v2": path})
    return back.select(*columns[:4], F.sha2("report_text", 256).alias("text_sha"), "comment")


@query(
    "reports_csv_split",
    f"""WITH {SQL_REPORTS} SELECT case_id, domain, clarity, expected_action, sha256(report_text) AS text_sha, NULL AS comment FROM reports""",
)
def reports_csv_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same file, its quoted line breaks included, read by as many tasks as it has parts."""
    path = _folder(spark)
    columns = ["case_id", "domain", "clarity", "expected_action", "report_text"]
    write_result(reports(spark, sf).select(*columns), path, fmt="csv")
    back = read_quoted_csv(spark, path, REPORTS)
    return back.select(*columns[:4], F.sha2("report_text", 256).alias("text_sha"), "comment")


@query(
    "runs_csv",
    f"""WITH {SQL_SIGNALS} SELECT case_id, severity, NULL AS confidence FROM signals WHERE clarity = 'clear'
UNION ALL SELECT case_id, severity, confidence FROM signals WHERE clarity <> 'clear'""",
)
def runs_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs with different columns, read by path and stacked."""
    from .views import signals

    base, clear = signals(spark, sf), F.col("clarity") == "clear"
    first, second = _folder(spark), _folder(spark)
    write_result(base.filter(clear).select("case_id", "severity"), first, fmt="csv")
    write_result(base.filter(~clear).select("case_id", "severity", "confidence"), second, fmt="csv")
    stacked = union_runs(read_runs(spark, [first, second]))
    return stacked.select(F.col("case_id").cast("bigint").alias("case_id"), "severity", F.col("confidence").cast("double").alias("confidence"))


def _write_dialect(df: DataFrame, path: str, delimiter: str) -> None:
    df.write.option("header", True).option("sep", delimiter).option("encoding", "ISO-8859-1").csv(path)


@query(
    "csv_dialect",
    f"""WITH {SQL_DOCS} SELECT case_id, CASE case_id % 5 WHEN 3 THEN 'x;"' || domain ELSE domain END AS domain,
  CASE case_id % 5 WHEN 1 THEN NULL ELSE CAST(case_id AS DOUBLE) / 4 END AS amount FROM docs WHERE case_id % 5 <> 2""",
)
def csv_dialect(spark: SparkSession, sf: str) -> DataFrame:
    """Semicolon file in Latin-1 with decimal commas, short, long and quoted lines; the delimiter is found from the header."""
    amount = F.regexp_replace((F.col("case_id") / 4).cast("string"), "[.]", ",")
    kind = F.col("case_id") % 5
    line = (
        F.when(kind == 1, F.concat_ws(";", "case_id", "domain"))
        .when(kind == 2, F.concat_ws(";", "case_id", "domain", amount, F.lit("")))
        .when(kind == 3, F.concat_ws(";", "case_id", F.concat(F.lit('"x;""'), "domain", F.lit('"')), amount))
        .otherwise(F.concat_ws(";", "case_id", "domain", amount))
    )
    path = _folder(spark)
    lines = docs(spark, sf).select(line.alias("case_id;domain;amount"))
    raw = {"header": "true", "sep": "\x01", "quote": "", "escapeQuotes": "false", "encoding": "ISO-8859-1"}
    lines.write.options(**raw).csv(path)
    return read_csv_dialect(spark, path, ["case_id", "amount"]).withColumn("case_id", F.col("case_id").cast("bigint"))


@query(
    "csv_folder",
    f"""WITH {SQL_DOCS} SELECT CAST(case_id AS VARCHAR) AS "Num_Acc", domain, NULL AS source FROM docs WHERE clarity = 'clear'
UNION ALL SELECT CAST(case_id AS VARCHAR), NULL, source FROM docs WHERE clarity <> 'clear'""",
)
def csv_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with two dialects and two spellings of the id column."""
    base, clear, path = docs(spark, sf), F.col("clarity") == "clear", _folder(spark)
    _write_dialect(base.filter(clear).select(F.col("case_id").alias("Accident_Id"), "domain"), f"{path}/part=a", ";")
    _write_dialect(base.filter(~clear).select(F.col("case_id").alias("accident_id"), "source"), f"{path}/part=b", "\t")
    return read_folder(spark, f"{path}/*").drop("part")


@query(
    "prepared_signals",
    f"""WITH {SQL_SIGNALS} SELECT case_id, confidence, CAST(n_risk_factors AS DOUBLE) AS n_risk_factors,
  CAST(n_missing_information AS DOUBLE) AS n_missing_information, severity, CAST(expected_action = 'escalation' AS INTEGER) AS label FROM lsignals""",
)
def prepared_signals(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    columns = ["case_id", "confidence", "n_risk_factors", "n_missing_information", "severity", "expected_action", "confidence_derived"]
    write_result(labelled_signals(spark, sf).select(*columns, "expected_action_llm"), path, fmt="csv")
    return read_prepared(spark, path).withColumn("case_id", F.col("case_id").cast("bigint"))


@query(
    "json_sinks",
    f"""WITH {SQL_SIGNALS} SELECT case_id, severity, confidence FROM signals WHERE clarity = 'clear'
UNION ALL SELECT case_id, severity, confidence FROM signals WHERE clarity <> 'clear'""",
)
def json_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of JSON lines."""
    from .views import signals

    base = signals(spark, sf).select("case_id", "severity", "confidence", "clarity")
    path = _folder(spark)
    for part in (F.col("clarity") == "clear", F.col("clarity") != "clear"):
        append_json(base.filter(part).drop("clarity"), path)
    schema = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("severity", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return read_json(spark, path, schema)


@query(
    "write_once",
    f"WITH {SQL_SIGNALS} SELECT case_id, severity FROM signals",
)
def write_once_query(spark: SparkSession, sf: str) -> DataFrame:
    """The second write to the same target is skipped."""
    from .views import signals

    base, path = signals(spark, sf), _folder(spark)
    write_once(base.select("case_id", "severity"), path)
    write_once(base.select("case_id", F.lit("changed").alias("severity")), path)
    return spark.read.parquet(path)


@query(
    "cache_round_trip",
    rf"""WITH {SQL_DOCS} SELECT sha256(report_text) AS cache_key, max(CAST(length(report_text) AS VARCHAR)) AS raw_json FROM docs GROUP BY report_text""",
)
def cache_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Responses appended in two batches, copies included; one row per key comes back."""
    path = _folder(spark)
    base = docs(spark, sf).select(
        F.sha2("report_text", 256).alias("cache_key"), F.length("report_text").cast("string").alias("raw_json"), "clarity"
    )
    for part in (F.col("clarity") == "clear", F.col("clarity") != "clear"):
        append_cache(base.filter(part), path)
    return latest_responses(read_cache(spark, path))


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger from the documents: domains are experiments, sources are runs."""
    runs = docs(spark, sf).groupBy("domain", "source").agg(
        F.max("case_id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.length("report_text")).alias("chars")
    )
    entries = F.array(
        F.struct(F.lit("metric").alias("kind"), F.lit("n_reports").alias("key"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("metric").alias("kind"), F.lit("n_chars").alias("key"), F.col("chars").cast("string").alias("value")),
        F.struct(F.lit("tag").alias("kind"), F.lit("source").alias("key"), F.col("source").alias("value")),
    )
    rows = runs.select(
        F.col("domain").alias("experiment"),
        F.col("source").alias("run_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("last")).alias("run_ts"),
        F.explode(entries).alias("e"),
    ).select("experiment", "run_id", "run_ts", "e.*")
    path = _folder(spark)
    append_ledger(rows.select(*LEDGER.names), path)
    return read_ledger(spark, path)


SQL_LATEST = f"""{SQL_DOCS}, runs AS (SELECT domain AS experiment, source AS run_id, max(case_id) AS last, count(*) AS n,
  sum(length(report_text)) AS chars FROM docs GROUP BY domain, source),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY last DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1)"""


@query(
    "run_ledger_latest",
    f"WITH {SQL_LATEST} SELECT experiment, run_id, CAST(1700000000 + last AS BIGINT) AS run_second FROM latest",
)
def run_ledger_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest_runs(_ledger(spark, sf)).select("experiment", "run_id", F.unix_seconds("run_ts").alias("run_second"))


@query(
    "run_ledger_restored",
    f"""WITH {SQL_LATEST} SELECT experiment, run_id, 'metric' AS kind, 'n_reports' AS key, CAST(n AS VARCHAR) AS value FROM latest
UNION ALL SELECT experiment, run_id, 'metric', 'n_chars', CAST(chars AS VARCHAR) FROM latest
UNION ALL SELECT experiment, run_id, 'tag', 'source', run_id FROM latest""",
)
def run_ledger_restored(spark: SparkSession, sf: str) -> DataFrame:
    return restore_latest(_ledger(spark, sf)).drop("run_ts")
