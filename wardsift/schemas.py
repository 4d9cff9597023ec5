"""Table schemas.  Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

REPORTS = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("clarity", T.StringType()),
        T.StructField("expected_action", T.StringType()),
        T.StructField("report_text", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("raw_json", T.StringType()),
    ]
)

# Every field of an annotator record is read as text, so one badly typed field does not make the
# whole record unreadable.
RESPONSE_TEXT = T.StructType(
    [
        T.StructField("expected_action", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("risk_factors", T.StringType()),
        T.StructField("uncertainty_level", T.StringType()),
        T.StructField("missing_information", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# Label texts and allowed values of the annotator record.
ESCALATE = "escalation"
NO_ESCALATE = "no_escalation"
LEVELS = ("low", "medium", "high")

# Names of keys, model features and columns that are not trained on.
SIGNAL_KEYS = ("case_id", "domain", "clarity")
NUMERIC_FEATURES = ("confidence", "n_risk_factors", "n_missing_information")
CATEGORICAL_FEATURES = ("severity", "uncertainty_level", "clarity", "domain")
UNTRAINED_COLUMNS = (
    "expected_action_final",
    "confidence_derived",
    "expected_action_llm",
    "missing_information",
    "risk_factors",
    "Unnamed: 0",
)
