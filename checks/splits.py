"""Split, signature and feature queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardsift.operators.features import FeatureSpec, class_weights, compress_patterns, fit_preprocessor
from wardsift.operators.splits import (
    assign_roles,
    class_shares,
    group_folds,
    group_shuffle_splits,
    group_sizes,
    group_statistics,
    stratified_folds,
    stratified_split,
    with_signature,
)
from wardsift.session import cut_lineage

from .evaluation import rounded
from .registry import query
from .views import SQL_SIGNALS, docs, labelled_signals, truth

SPEC = FeatureSpec()
SHUFFLE_SPLITS = 30


def _label() -> Column:
    return (F.col("expected_action") == "escalation").cast("int").alias("label")


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with label, ready for training."""
    return labelled_signals(spark, sf).select("case_id", *SPEC.columns, _label())


def labels_only(spark: SparkSession, sf: str) -> DataFrame:
    """Key and label; texts are not read."""
    return docs(spark, sf).select("case_id").join(truth(spark, sf), "case_id").select("case_id", _label())


SQL_ROWS = """train_rows AS (SELECT case_id, confidence, n_risk_factors, n_missing_information, severity, uncertainty_level, clarity,
  domain, CAST(expected_action = 'escalation' AS INTEGER) AS label FROM lsignals),
signed AS (SELECT *, concat_ws('|', format('{:.6f}', confidence), n_risk_factors, n_missing_information, severity, uncertainty_level,
  clarity, domain) AS group_key FROM train_rows),
groups AS (SELECT group_key, count(*) AS size FROM signed GROUP BY group_key)"""


@query("signature_groups", f"WITH {SQL_SIGNALS}, {SQL_ROWS} SELECT group_key, size FROM groups")
def signature_groups(spark: SparkSession, sf: str) -> DataFrame:
    return group_sizes(with_signature(training_rows(spark, sf), SPEC.columns))


def _group_table(spark: SparkSession, sf: str) -> DataFrame:
    """The groups, written once for operators that look at them more than once."""
    return cut_lineage(signature_groups(spark, sf))


@query(
    "signature_statistics",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}
SELECT count(*) AS n_groups, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, CAST(min(size) AS DOUBLE) AS min,
  quantile_cont(CAST(size AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(size AS DOUBLE), 0.5) AS p50,
  quantile_cont(CAST(size AS DOUBLE), 0.75) AS p75, CAST(max(size) AS DOUBLE) AS max FROM groups""",
)
def signature_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(group_statistics(signature_groups(spark, sf)))


@query(
    "split_stratified",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}, ranked AS (SELECT case_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('holdout|42|0|' || case_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM train_rows)
SELECT case_id, label, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS role FROM ranked""",
)
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(labels_only(spark, sf), "case_id")


@query(
    "split_hash_draw",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}
SELECT case_id, label, CASE WHEN substr(md5('holdout|42|0|' || case_id), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS role
FROM train_rows""",
)
def split_hash_draw(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(labels_only(spark, sf), "case_id", exact=False)


@query(
    "split_stratified_folds",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}, ranked AS (SELECT case_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('folds|42|0|' || case_id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM train_rows)
SELECT case_id, label, CAST(1 + (rn > ceil(CAST(0.2 AS DOUBLE) * n))::INT + (rn > ceil(CAST(0.4 AS DOUBLE) * n))::INT
  + (rn > ceil(CAST(0.6 AS DOUBLE) * n))::INT + (rn > ceil(CAST(0.8 AS DOUBLE) * n))::INT AS INTEGER) AS fold FROM ranked""",
)
def split_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_folds(labels_only(spark, sf), "case_id")


SQL_SHUFFLE = """ranked AS (SELECT split_id, group_key, row_number() OVER (PARTITION BY split_id
    ORDER BY md5('group_shuffle|42|' || split_id || '|' || group_key)) AS rn, count(*) OVER (PARTITION BY split_id) AS n
  FROM groups, range(1, 31) r(split_id)),
roles AS (SELECT CAST(split_id AS INTEGER) AS split_id, group_key,
  CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS role FROM ranked)"""




@query("split_group_shuffle", f"WITH {SQL_SIGNALS}, {SQL_ROWS}, {SQL_SHUFFLE} SELECT split_id, group_key, role FROM roles")
def split_group_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return group_shuffle_splits(_group_table(spark, sf), SHUFFLE_SPLITS)


@query(
    "split_class_shares",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}, {SQL_SHUFFLE},
counts AS (SELECT split_id, role, label, count(*) AS n FROM signed JOIN roles USING (group_key) GROUP BY split_id, role, label)
SELECT split_id, role, label, n, round(n / sum(n) OVER (PARTITION BY split_id, role), 6) AS share FROM counts""",
)
def split_class_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(with_signature(training_rows(spark, sf), SPEC.columns).select("case_id", "label", "group_key"))
    return rounded(class_shares(assign_roles(rows, group_shuffle_splits(group_sizes(rows), SHUFFLE_SPLITS))))


SQL_FOLDS = """ordered AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS i FROM groups),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS size, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads, CAST(0 AS BIGINT) AS fold
  UNION ALL
  SELECT o.i, o.size, list_transform(d.loads, lambda v, j: v + CASE WHEN j = list_position(d.loads, list_min(d.loads)) THEN o.size ELSE 0 END),
         CAST(list_position(d.loads, list_min(d.loads)) AS BIGINT)
  FROM dealt d JOIN ordered o ON o.i = d.i + 1),
places AS (SELECT size, fold, row_number() OVER (PARTITION BY size ORDER BY fold) AS r FROM dealt WHERE i > 0),
members AS (SELECT size, group_key, row_number() OVER (PARTITION BY size ORDER BY md5('group_kfold|42|0|' || group_key)) AS r FROM groups),
folds AS (SELECT group_key, size, CAST(fold AS INTEGER) AS fold FROM members JOIN places USING (size, r))"""


@query(
    "split_group_kfold",
    f"WITH RECURSIVE {SQL_SIGNALS}, {SQL_ROWS}, {SQL_FOLDS} SELECT group_key, size, fold FROM folds",
)
def split_group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return group_folds(_group_table(spark, sf), 5)


@query(
    "training_patterns",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}
SELECT confidence, n_risk_factors, n_missing_information, severity, uncertainty_level, clarity, domain, label, count(*) AS weight
FROM train_rows GROUP BY ALL""",
)
def training_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return compress_patterns(training_rows(spark, sf), SPEC)


def _sql_scaled(name: str) -> str:
    return f"round(({name} - avg({name}) OVER ()) / coalesce(nullif(stddev_pop({name}) OVER (), 0), 1), 6) AS {name}"


def _sql_dummies(column: str, levels: tuple[str, ...]) -> str:
    return ", ".join(f"CAST({column} = '{level}' AS DOUBLE) AS {column}_{level}" for level in levels)


@query(
    "features_scaled_onehot",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}
SELECT case_id, {_sql_scaled("confidence")}, {_sql_scaled("n_risk_factors")}, {_sql_scaled("n_missing_information")},
  {_sql_dummies("severity", ("low", "medium"))}, {_sql_dummies("uncertainty_level", ("low", "medium"))},
  {_sql_dummies("clarity", ("clear",))}, {_sql_dummies("domain", ("en", "es", "fr"))} FROM train_rows""",
)
def features_scaled_onehot(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(training_rows(spark, sf))
    prepared = fit_preprocessor(compress_patterns(rows, SPEC), SPEC)
    encoded = dict(zip(prepared.feature_names, prepared.encoded_columns(), strict=True))
    return rounded(rows.select("case_id", *[c.alias(n) for n, c in encoded.items()]))


@query(
    "class_weights",
    f"""WITH {SQL_SIGNALS}, {SQL_ROWS}
SELECT label, count(*) AS n_class, round((SELECT count(*) FROM train_rows) / (2 * count(*)), 6) AS class_weight FROM train_rows GROUP BY label""",
)
def class_weights_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(class_weights(labels_only(spark, sf)))
