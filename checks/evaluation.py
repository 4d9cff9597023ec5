"""Evaluation queries: confusion counts, metrics, curves, sweeps, summaries over splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.functions.labels import decision_at, encode_label, encode_prediction
from wardsift.operators.curves import (
    best_threshold,
    curve_areas,
    curve_points,
    pr_points,
    roc_points,
    score_counts,
    threshold_sweep,
)
from wardsift.operators.decisions import decide
from wardsift.operators.evaluation import classification_report, confusion, with_binary_metrics
from wardsift.operators.frames import sort_top_k
from wardsift.operators.summaries import CV_COLUMNS, TOP_ORDER, cv_summary, defined_splits, grid_summary
from wardsift.session import cut_lineage

from .registry import query
from .views import SQL_SIGNALS, labelled_signals, scored, sql_decision

METRICS = ("precision", "recall", "f1", "f2")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _encoded(spark: SparkSession, sf: str, version: str = "v6") -> DataFrame:
    decided = decide(labelled_signals(spark, sf), version)
    return decided.select(
        "case_id",
        "domain",
        "source",
        encode_label("expected_action").alias("label"),
        encode_prediction("expected_action_final").alias("prediction"),
    )


SQL_CELLS = """CAST(count(*) FILTER (NOT y AND NOT p) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT y AND p) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (y AND p) AS BIGINT) AS tp"""

SQL_METRICS = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1, coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2"""

SQL_DECIDED = f"decided AS (SELECT domain, source, expected_action = 'escalation' AS y, {sql_decision('v6')} AS p FROM lsignals)"


@query("confusion_by_domain", f"WITH {SQL_SIGNALS}, {SQL_DECIDED} SELECT domain, {SQL_CELLS} FROM decided GROUP BY domain")
def confusion_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return confusion(_encoded(spark, sf), ["domain"])


@query(
    "binary_metrics",
    f"""WITH {SQL_SIGNALS}, {SQL_DECIDED}, c AS (SELECT {SQL_CELLS} FROM decided), m AS (SELECT *, {SQL_METRICS} FROM c)
SELECT tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM m""",
)
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(with_binary_metrics(confusion(_encoded(spark, sf))))


@query(
    "classification_report",
    f"""WITH {SQL_SIGNALS}, {SQL_DECIDED}, c AS (SELECT {SQL_CELLS} FROM decided),
m AS (SELECT *, tn + fp + fn + tp AS n, {SQL_METRICS}, coalesce(tn / nullif(tn + fn, 0), 0) AS nprecision,
  coalesce(tn / nullif(tn + fp, 0), 0) AS nrecall, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS nf1 FROM c),
rows AS (
SELECT 'no_escalation' AS class, nprecision AS precision, nrecall AS recall, nf1 AS f1, tn + fp AS support FROM m UNION ALL
SELECT 'escalation', precision, recall, f1, tp + fn FROM m UNION ALL
SELECT 'accuracy', (tn + tp) / n, (tn + tp) / n, (tn + tp) / n, n FROM m UNION ALL
SELECT 'macro avg', (precision + nprecision) / 2, (recall + nrecall) / 2, (f1 + nf1) / 2, n FROM m UNION ALL
SELECT 'weighted avg', (precision * (tp + fn) + nprecision * (tn + fp)) / n, (recall * (tp + fn) + nrecall * (tn + fp)) / n,
       (f1 * (tp + fn) + nf1 * (tn + fp)) / n, n FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rows""",
)
def classification_report_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification_report(confusion(_encoded(spark, sf))))


def sql_points(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""freq AS (SELECT {keys}score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY {keys}score),
pts AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w - sum(pos) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER ({part}) AS BIGINT) AS n_pos, CAST(sum(n - pos) OVER ({part}) AS BIGINT) AS n_neg
  FROM freq WINDOW w AS ({part}ORDER BY score DESC))"""


def sql_areas(by: str = "") -> str:
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""areas AS (SELECT {keys}max(n_pos) AS n_pos, max(n_neg) AS n_neg,
  sum((n - pos) * (tp - pos / 2)) / nullif(max(n_pos) * max(n_neg), 0) AS roc_auc,
  coalesce(sum(pos * tp / (tp + fp)) / nullif(max(n_pos), 0), 0) AS pr_auc FROM pts{group})"""


def _points(spark: SparkSession, sf: str, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    return curve_points(score_counts(scored(spark, sf), keys), keys)


@query(
    "roc_pr_auc",
    f"""WITH {SQL_SIGNALS}, {sql_points()}, {sql_areas()}
SELECT n_pos, n_neg, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
)
def roc_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curve_areas(_points(spark, sf)))


@query(
    "roc_pr_auc_by_domain",
    f"""WITH {SQL_SIGNALS}, {sql_points("domain")}, {sql_areas("domain")}
SELECT domain, n_pos, n_neg, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
)
def roc_pr_auc_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curve_areas(_points(spark, sf, ["domain"]), ["domain"]))


@query(
    "roc_points",
    f"""WITH {SQL_SIGNALS}, {sql_points()}
SELECT round(score, 6) AS score, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM pts""",
)
def roc_points_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_points(_points(spark, sf)))


@query(
    "pr_points",
    f"""WITH {SQL_SIGNALS}, {sql_points()}
SELECT round(score, 6) AS score, round(tp / n_pos, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM pts""",
)
def pr_points_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pr_points(_points(spark, sf)))


def sql_sweep(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""cuts AS (SELECT i * CAST(0.01 AS DOUBLE) AS threshold FROM range(101) r(i)),
swept AS (SELECT {keys}threshold, count(*) AS n_test, CAST(sum(label) AS BIGINT) AS n_pos,
  CAST(count(*) FILTER (label = 1 AND score >= threshold) AS BIGINT) AS tp,
  CAST(count(*) FILTER (label = 0 AND score >= threshold) AS BIGINT) AS fp,
  CAST(count(*) FILTER (label = 1 AND score < threshold) AS BIGINT) AS fn FROM scored, cuts GROUP BY {keys}threshold),
sweep AS (SELECT *, n_pos / n_test AS pos_rate, {SQL_METRICS} FROM swept)"""


SWEEP_COLUMNS = """round(threshold, 6) AS threshold, n_test, n_pos, round(pos_rate, 6) AS pos_rate, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2"""


@query("threshold_sweep", f"WITH {SQL_SIGNALS}, {sql_sweep()} SELECT {SWEEP_COLUMNS} FROM sweep")
def threshold_sweep_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(threshold_sweep(scored(spark, sf)))


@query("threshold_sweep_by_domain", f"WITH {SQL_SIGNALS}, {sql_sweep('domain')} SELECT domain, {SWEEP_COLUMNS} FROM sweep")
def threshold_sweep_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(threshold_sweep(scored(spark, sf), ["domain"]))


@query(
    "best_threshold",
    f"""WITH {SQL_SIGNALS}, {sql_sweep("domain")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY f2 DESC, threshold) AS rn FROM sweep)
SELECT domain, {SWEEP_COLUMNS} FROM ranked WHERE rn = 1""",
)
def best_threshold_query(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(best_threshold(threshold_sweep(scored(spark, sf), ["domain"]), ["domain"]))


CUTS = (0.2, 0.4, 0.6)


def _per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows as cross-validation makes them: sources play the splits, fixed cuts the configurations."""
    rows = cut_lineage(scored(spark, sf))
    by = ["source"]
    areas = curve_areas(curve_points(score_counts(rows, by), by), by).select("source", "roc_auc", "pr_auc")
    best = best_threshold(threshold_sweep(rows, by), by).select("source", F.col("threshold").alias("best_t"))
    cuts = F.array(*[F.struct(F.lit(i).alias("config_id"), F.lit(t).alias("C")) for i, t in enumerate(CUTS)])
    decided = rows.withColumn("cut", F.explode(cuts)).select(
        "source", "cut.*", "label", decision_at("score", F.col("cut")["C"]).alias("prediction")
    )
    counts = with_binary_metrics(confusion(decided, ["config_id", "C", "source"]))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.join(areas, "source").join(best, "source").select(
        "config_id",
        "C",
        F.lit(0.0).alias("l1_ratio"),
        F.lit("None").alias("class_weight"),
        "source",
        n.alias("n_test"),
        (n / total).alias("part_test"),
        ((F.col("fn") + F.col("tp")) / n).alias("pos_rate"),
        "best_t",
        "roc_auc",
        "pr_auc",
        *METRICS,
    )


SQL_PER_SOURCE = f"""{sql_points("source")}, {sql_areas("source")}, {sql_sweep("source")},
best AS (SELECT source, threshold AS best_t FROM
  (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f2 DESC, threshold) AS rn FROM sweep) WHERE rn = 1),
configs(config_id, c) AS (VALUES {", ".join(f"({i}, CAST({t} AS DOUBLE))" for i, t in enumerate(CUTS))}),
flags AS (SELECT config_id, c, source, label = 1 AS y, score >= c AS p FROM scored, configs),
cells AS (SELECT config_id, c, source, {SQL_CELLS} FROM flags GROUP BY config_id, c, source),
results AS (SELECT config_id, c AS "C", CAST(0 AS DOUBLE) AS l1_ratio, 'None' AS class_weight, cells.source, tn + fp + fn + tp AS n_test,
  (tn + fp + fn + tp) / (SELECT count(*) FROM scored) AS part_test, (fn + tp) / (tn + fp + fn + tp) AS pos_rate, best_t,
  areas.roc_auc, areas.pr_auc, {SQL_METRICS}
  FROM cells JOIN areas USING (source) JOIN best USING (source))"""


@query(
    "per_source_results",
    f"""WITH {SQL_SIGNALS}, {SQL_PER_SOURCE}
SELECT config_id, "C", l1_ratio, class_weight, source, n_test, round(part_test, 6) AS part_test, round(pos_rate, 6) AS pos_rate,
  round(best_t, 6) AS best_t, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM results""",
)
def per_source_results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_per_source(spark, sf))


_CV_LONG = " UNION ALL ".join(f"SELECT config_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM results" for c in CV_COLUMNS)
_CV_Q = ", ".join(
    f"round(quantile_cont(value, {q}), 6) AS {n}"
    for n, q in {"median": 0.5, "q5": 0.05, "q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9, "q95": 0.95}.items()
)


@query(
    "cv_summary_by_source",
    f"""WITH {SQL_SIGNALS}, {SQL_PER_SOURCE}, long AS ({_CV_LONG})
SELECT config_id, metric, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max, {_CV_Q},
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS "IQR" FROM long GROUP BY config_id, metric""",
)
def cv_summary_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cv_summary(_per_source(spark, sf), ["config_id"]))


@query(
    "defined_splits",
    f"""WITH {SQL_SIGNALS}, {SQL_PER_SOURCE}
SELECT config_id, count(roc_auc) AS n_defined, count(*) AS n_splits FROM results GROUP BY config_id""",
)
def defined_splits_query(spark: SparkSession, sf: str) -> DataFrame:
    return defined_splits(_per_source(spark, sf), ["config_id"])


def _sql_core(name: str) -> str:
    return (
        f"round(avg({name}), 6) AS mean_{name}, round(quantile_cont({name}, 0.5), 6) AS median_{name}, "
        f"round(stddev_pop({name}), 6) AS std_{name}"
    )


SQL_GRID = f"""SELECT config_id, "C", l1_ratio, class_weight, count(*) AS n_splits, {_sql_core("f2")}, round(min(f2), 6) AS min_f2,
  round(quantile_cont(f2, 0.1), 6) AS q10_f2, round(quantile_cont(f2, 0.25), 6) AS q25_f2, {_sql_core("pr_auc")}, {_sql_core("precision")},
  {_sql_core("recall")}, {_sql_core("best_t")}, round(quantile_cont(best_t, 0.1), 6) AS q10_best_t,
  round(quantile_cont(best_t, 0.25), 6) AS q25_best_t FROM results GROUP BY config_id, "C", l1_ratio, class_weight"""


@query("grid_summary_by_source", f"WITH {SQL_SIGNALS}, {SQL_PER_SOURCE} {SQL_GRID}")
def grid_summary_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid_summary(_per_source(spark, sf)))


@query(
    "grid_top_by_source",
    f"""WITH {SQL_SIGNALS}, {SQL_PER_SOURCE}, grid AS ({SQL_GRID})
SELECT config_id, "C", q25_f2, median_f2, mean_f2 FROM grid ORDER BY q25_f2 DESC, median_f2 DESC, mean_f2 DESC, config_id LIMIT 2""",
)
def grid_top_by_source(spark: SparkSession, sf: str) -> DataFrame:
    summary = rounded(grid_summary(_per_source(spark, sf)))
    return sort_top_k(summary, TOP_ORDER, ["config_id", "C", *TOP_ORDER], 2, tie_break="config_id")[1]
