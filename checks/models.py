"""Model queries.  Those without SQL are held to the optimality conditions of every model (:mod:`checks.model_optimality`) and, in
tests, to an independent solver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.operators.models import ModelConfig, coefficient_table
from wardsift.operators.profile import with_text_metrics
from wardsift.operators.validation import cross_fit, group_training_set, holdout_training_set
from wardsift.plans.train import (
    PROBE_FEATURES,
    final_model,
    grid_search,
    group_cross_validation,
    parameter_grid,
    shortcut_probe,
    single_run,
    validate_top,
)
from wardsift.session import cut_lineage

from .evaluation import SQL_CELLS, SQL_METRICS, rounded
from .model_optimality import SQL_HOLDOUT, SQL_WHOLE, sql_scores
from .registry import query
from .splits import SPEC, training_rows
from .texts import SQL_METRICS as SQL_TEXT_METRICS
from .views import SQL_DOCS, SQL_TRUTH, docs, truth

SEARCH_SPLITS = 30
SHUFFLE_SPLITS = 50
FOLDS = 5


@query("logreg_single_run")
def logreg_single_run(spark: SparkSession, sf: str) -> DataFrame:
    run = single_run(training_rows(spark, sf))
    return run.metrics_at_best.drop("C", "l1_ratio", "class_weight")


@query("logreg_single_run_report")
def logreg_single_run_report(spark: SparkSession, sf: str) -> DataFrame:
    return single_run(training_rows(spark, sf)).report


@query("logreg_group_cv")
def logreg_group_cv(spark: SparkSession, sf: str) -> DataFrame:
    return group_cross_validation(training_rows(spark, sf), "group_kfold", FOLDS).best_t_results


@query("logreg_group_cv_summary")
def logreg_group_cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return group_cross_validation(training_rows(spark, sf), "group_shuffle", SHUFFLE_SPLITS).summary


@query("logreg_grid")
def logreg_grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_search(training_rows(spark, sf), parameter_grid(), SEARCH_SPLITS).summary


@query("logreg_topk_validation")
def logreg_topk_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(training_rows(spark, sf))
    top = grid_search(rows, parameter_grid(), SEARCH_SPLITS).top
    return validate_top(rows, top, FOLDS).best_t_results


@query("logreg_scores", sql_scores(SQL_HOLDOUT, ModelConfig(C=1.0, l1_ratio=1.0)))
def logreg_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled report scored by one L1 model fitted on the train side of a holdout split."""
    rows = training_rows(spark, sf)
    data = holdout_training_set(rows, SPEC)
    model = cross_fit(data, [ModelConfig(C=1.0, l1_ratio=1.0)])[0, 1]
    return rows.select("case_id", "label", F.round(model.probability(), 4).alias("score"))


@query("logreg_final_model", sql_scores(SQL_WHOLE, ModelConfig(class_weight="balanced")))
def logreg_final_model(spark: SparkSession, sf: str) -> DataFrame:
    """MLlib model of all labelled reports, applied to them as an expression."""
    rows = cut_lineage(training_rows(spark, sf))
    return rows.select("case_id", "label", F.round(final_model(rows).probability(), 4).alias("score"))


@query("logreg_coefficients")
def logreg_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    data = group_training_set(training_rows(spark, sf), SPEC, "group_kfold", FOLDS)
    return coefficient_table(spark, cross_fit(data, [ModelConfig()]))


def _probe_sql(steps: int = 15) -> str:
    """Newton steps for all folds over scaled metrics and a constant; each system is solved by elimination over a list of rows."""
    n = len(PROBE_FEATURES) + 1
    z = range(1, n + 1)
    scale = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in PROBE_FEATURES)
    ridge = [*[f"1 / std_{c} ** 2" for c in PROBE_FEATURES], "0"]
    margin = " + ".join(f"f.b[{k}] * z{k}" for k in z)
    rows = ", ".join("[" + ", ".join([f"h{min(a, b)}_{max(a, b)}" + (f" + {ridge[a - 1]}" if a == b else "") for b in z] + [f"g{a} + {ridge[a - 1]} * b[{a}]"]) + "]" for a in z)
    k = "CAST(s[1][1] AS INTEGER)"
    eliminate = f"""list_transform(m, lambda row, i: CASE WHEN i = {k} THEN list_transform(row, lambda v: v / row[{k}])
      ELSE list_transform(row, lambda v, j: v - row[{k}] * m[{k}][j] / m[{k}][{k}]) END)"""
    return f"""WITH RECURSIVE {SQL_DOCS}, {SQL_TRUTH}, {SQL_TEXT_METRICS},
mrows AS (SELECT metrics.*, CAST(expected_action = 'escalation' AS INTEGER) AS y FROM metrics JOIN truth USING (case_id)),
cut AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('folds|42|0|' || case_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM mrows),
scale AS (SELECT {scale} FROM mrows),
folded AS (SELECT y, {", ".join(f"CAST(({c} - mean_{c}) / std_{c} AS DOUBLE) AS z{i}" for i, c in enumerate(PROBE_FEATURES, 1))}, CAST(1 AS DOUBLE) AS z{n},
  1 + {" + ".join(f"(rn > ceil(CAST({i / FOLDS} AS DOUBLE) * n))::INT" for i in range(1, FOLDS))} AS fold FROM cut, scale),
pivots AS (SELECT list([[CAST(i AS DOUBLE)]] ORDER BY i) AS ks FROM range(1, {n + 1}) t(i)),
fit AS (
  SELECT fold, 0 AS it, list_transform(range({n}), lambda k: CAST(0 AS DOUBLE)) AS b FROM range(1, {FOLDS + 1}) r(fold)
  UNION ALL
  SELECT fold, it + 1, list_transform(b, lambda v, i: v - list_reduce(ks, lambda m, s: {eliminate}, [{rows}])[i][{n + 1}])
  FROM (SELECT fold, it, b, {", ".join(f"sum((p - y) * z{a}) AS g{a}" for a in z)},
               {", ".join(f"sum(p * (1 - p) * z{a} * z{b}) AS h{a}_{b}" for a in z for b in z if a <= b)}
        FROM (SELECT f.fold, f.it, f.b, d.* EXCLUDE (fold), CAST(1 AS DOUBLE) / (1 + exp(-({margin}))) AS p
              FROM fit f JOIN folded d ON d.fold <> f.fold WHERE f.it < {steps})
        GROUP BY fold, it, b), scale, pivots),
cells AS (SELECT fold, {SQL_CELLS} FROM (SELECT d.fold, d.y = 1 AS y, {margin} >= 0 AS p FROM folded d JOIN fit f ON f.fold = d.fold AND f.it = {steps}) GROUP BY fold),
per_fold AS (SELECT fold, {SQL_METRICS} FROM cells)
SELECT count(*) AS n_folds, round(avg(f1), 4) AS f1_mean, round(stddev_pop(f1), 4) AS f1_std FROM per_fold"""


@query("shortcut_probe", _probe_sql())
def shortcut_probe_query(spark: SparkSession, sf: str) -> DataFrame:
    measured = with_text_metrics(docs(spark, sf)).select("case_id", *PROBE_FEATURES)
    label = (F.col("expected_action") == "escalation").cast("int")
    return rounded(shortcut_probe(measured.join(truth(spark, sf), "case_id").withColumn("label", label)), 4)
