"""The model family with an SQL twin: a logistic model of one numeric feature and an intercept.

The twin fits by Newton steps in a recursive query, with the 2 x 2 Hessian inverted in closed form, and derives
scores, sweeps, thresholds and metrics from it.  Results are compared at four digits.  The full-feature queries are in
:mod:`checks.models`.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.operators.features import FeatureSpec
from wardsift.operators.models import ModelConfig, coefficient_table, fit_table, score_fits
from wardsift.operators.summaries import TOP_ORDER
from wardsift.operators.splits import SEED, TEST_SHARE, group_folds, group_sizes, with_signature
from wardsift.operators.validation import cross_fit, group_training_set, holdout_training_set, inner_draw
from wardsift.plans.train import final_model, grid_search, group_cross_validation, shortcut_probe, single_run, validate_top
from wardsift.session import cut_lineage, ensure_checkpoint_dir
from wardsift.sources.tables import load_model, runtime_metrics, save_model, timed, write_result

from .evaluation import SQL_CELLS, SQL_GRID, SQL_METRICS, rounded, sql_areas, sql_points, sql_sweep
from .registry import query
from .splits import SQL_FOLDS, SQL_SHUFFLE, _label
from .views import SQL_SIGNALS, labelled_signals

SPEC = FeatureSpec(("n_words",), ())
CONFIGS = [ModelConfig(C=c, class_weight=w) for c in (0.01, 1.0) for w in (None, "balanced")]
BALANCED = ModelConfig(class_weight="balanced")
NEWTON_STEPS = 14


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return labelled_signals(spark, sf).select("case_id", "n_words", _label())


SQL_MROWS = f"""{SQL_SIGNALS}, mrows AS (SELECT case_id, CAST(n_words AS DOUBLE) AS x, CAST(n_words AS VARCHAR) AS group_key,
  CAST(expected_action = 'escalation' AS INTEGER) AS y FROM lsignals),
groups AS (SELECT group_key, count(*) AS size FROM mrows GROUP BY group_key)"""

HOLDOUT = """{p}roled AS (SELECT *, 1 AS split_id, row_number() OVER (PARTITION BY y ORDER BY md5('holdout|42|0|' || case_id))
  <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY y)) AS test FROM mrows)"""
SHUFFLE = SQL_SHUFFLE + """,
{p}roled AS (SELECT mrows.*, split_id, role = 'test' AS test FROM mrows JOIN roles USING (group_key))"""
KFOLD = SQL_FOLDS + """,
{p}roled AS (SELECT mrows.*, s.split_id, fold = s.split_id AS test FROM mrows JOIN folds USING (group_key), range(1, 6) s(split_id))"""


def sql_fit(placed: str, configs: str, p: str = "") -> str:
    """CTEs from split rows to models (``{p}model``), scores and result rows at 0.5 and at the best threshold."""
    prob = "CAST(1 AS DOUBLE) / (1 + exp(-(b0 + b1 * (x - mean) / std)))"

    def results(name: str, cut: str) -> str:
        return f"""{p}{name} AS (SELECT config_id, split_id, c AS "C", tn + fp + fn + tp AS n_test,
  (tn + fp + fn + tp) / (SELECT count(*) FROM mrows) AS part_test, (fn + tp) / (tn + fp + fn + tp) AS pos_rate, best_t, roc_auc, pr_auc,
  {SQL_METRICS}, CASE WHEN balanced THEN 'balanced' ELSE 'None' END AS class_weight, CAST(0 AS DOUBLE) AS l1_ratio
  FROM (SELECT config_id, split_id, ks, best_t, {SQL_CELLS}
        FROM (SELECT *, label = 1 AS y, score >= {cut} AS p FROM {p}tested JOIN {p}best USING (ks)) GROUP BY ALL)
  JOIN {p}areas USING (ks) JOIN {p}configs USING (config_id))"""

    return f"""{placed.replace("{p}", p)},
{p}placed AS (SELECT *, NOT test AND row_number() OVER (PARTITION BY split_id, y, test ORDER BY md5('inner|42|' || split_id || '|' || case_id))
  <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY split_id, y, test)) AS held FROM {p}roled),
{p}configs(config_id, c, balanced) AS ({configs}),
{p}train AS (SELECT split_id, side, x, y, count(*) AS w FROM {p}placed, (VALUES ('outer'), ('inner')) v(side)
  WHERE NOT test AND (side = 'outer' OR NOT held) GROUP BY ALL),
{p}stats AS (SELECT split_id, side, sum(w * x) / sum(w) AS mean, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS std,
  sum(w) AS n, sum(w) FILTER (y = 0) AS n0, sum(w) FILTER (y = 1) AS n1 FROM {p}train GROUP BY ALL),
{p}design AS (SELECT config_id, c, split_id, side, (x - mean) / std AS z, y,
  CAST(w * CASE WHEN balanced THEN n / (CAST(2 AS DOUBLE) * CASE y WHEN 0 THEN n0 ELSE n1 END) ELSE 1 END AS DOUBLE) AS w
  FROM {p}train JOIN {p}stats USING (split_id, side), {p}configs),
{p}fit AS (
  SELECT DISTINCT config_id, split_id, side, 0 AS it, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM {p}design
  UNION ALL
  SELECT config_id, split_id, side, it + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT config_id, split_id, side, it, b0, b1, sum(c * w * (p - y)) + b0 AS g0, sum(c * w * (p - y) * z) + b1 AS g1,
          sum(c * w * p * (1 - p)) + 1 AS h00, sum(c * w * p * (1 - p) * z) AS h01, sum(c * w * p * (1 - p) * z * z) + 1 AS h11
        FROM (SELECT f.*, d.c, d.z, d.y, d.w, CAST(1 AS DOUBLE) / (1 + exp(-(f.b0 + f.b1 * d.z))) AS p
              FROM {p}fit f JOIN {p}design d USING (config_id, split_id, side) WHERE f.it < {NEWTON_STEPS})
        GROUP BY config_id, split_id, side, it, b0, b1)),
{p}model AS (SELECT config_id, split_id, side, b0, b1, mean, std FROM {p}fit JOIN {p}stats USING (split_id, side) WHERE it = {NEWTON_STEPS}),
{p}tested AS (SELECT config_id || '|' || split_id AS ks, config_id, split_id, y AS label, {prob} AS score
  FROM {p}placed JOIN {p}model USING (split_id) WHERE test AND side = 'outer'),
{p}best AS (WITH scored AS (SELECT config_id || '|' || split_id AS ks, y AS label, {prob} AS score
    FROM {p}placed JOIN {p}model USING (split_id) WHERE NOT test AND held AND side = 'inner'), {sql_sweep("ks")}
  SELECT ks, threshold AS best_t FROM (SELECT *, row_number() OVER (PARTITION BY ks ORDER BY f2 DESC, threshold) AS rn FROM sweep) WHERE rn = 1),
{p}areas AS (WITH scored AS (SELECT ks, label, score FROM {p}tested), {sql_points("ks")}, {sql_areas("ks")} SELECT ks, roc_auc, pr_auc FROM areas),
{results("results", "0.5")},
{results("best_results", "best_t")}"""


def _configs(*configs: ModelConfig) -> str:
    return "VALUES " + ", ".join(f"({i}, CAST({c.C} AS DOUBLE), {str(c.class_weight == 'balanced').lower()})" for i, c in enumerate(configs))


NUMBERS = ("part_test", "pos_rate", "best_t", "roc_auc", "pr_auc", "precision", "recall", "f1", "f2")
RESULT = "config_id, split_id, n_test, " + ", ".join(f"round({c}, 4) AS {c}" for c in NUMBERS)
RESULT_COLUMNS = ["config_id", "split_id", "n_test", *NUMBERS]


def _result(df: DataFrame) -> DataFrame:
    return rounded(df.select(*RESULT_COLUMNS), 4)


@query(
    "split_inner_validation",
    f"""WITH RECURSIVE {SQL_MROWS}, {sql_fit(KFOLD, _configs(BALANCED))}
SELECT case_id, CAST(split_id AS INTEGER) AS split_id, y AS label, CASE WHEN held THEN 'test' ELSE 'train' END AS role FROM placed WHERE NOT test""",
)
def split_inner_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The inner draw of every fold: inside its train side, stratified there."""
    rows = cut_lineage(with_signature(_rows(spark, sf), SPEC.columns))
    folds = group_folds(cut_lineage(group_sizes(rows)), 5)
    marked = rows.join(folds, "group_key").withColumn("test_in", F.array("fold"))
    drawn = inner_draw(marked.select("case_id", "label", "test_in"), 5, "case_id", "label", TEST_SHARE, SEED)
    return drawn.select("case_id", "split_id", "label", F.when(F.col("held"), "test").otherwise("train").alias("role"))


@query("model_single_run", f"WITH RECURSIVE {SQL_MROWS}, {sql_fit(HOLDOUT, _configs(BALANCED))} SELECT {RESULT} FROM best_results")
def model_single_run(spark: SparkSession, sf: str) -> DataFrame:
    return _result(single_run(_rows(spark, sf), BALANCED, SPEC).metrics_at_best)


@query(
    "model_scores",
    f"""WITH RECURSIVE {SQL_MROWS}, {sql_fit(HOLDOUT, _configs(ModelConfig()))}
SELECT case_id, y AS label, round(CAST(1 AS DOUBLE) / (1 + exp(-(b0 + b1 * (x - mean) / std))), 4) AS score FROM mrows, model WHERE side = 'outer'""",
)
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(_rows(spark, sf))
    fits = cross_fit(holdout_training_set(rows, SPEC), [ModelConfig()])
    scored = score_fits(rows.withColumn("split_id", F.when(F.col("label") >= 0, 1)), fit_table(spark, fits), SPEC)
    return scored.select("case_id", "label", F.round("score", 4).alias("score"))


@query(
    "model_coefficients",
    f"""WITH RECURSIVE {SQL_MROWS}, {sql_fit(KFOLD, _configs(*CONFIGS))}
SELECT config_id, CAST(split_id AS INTEGER) AS split_id, 'n_words' AS feature, round(b1, 4) AS coef, true AS converged FROM model WHERE side = 'outer'""",
)
def model_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    data = group_training_set(_rows(spark, sf), SPEC, "group_kfold", 5)
    return rounded(coefficient_table(spark, cross_fit(data, CONFIGS)).drop("passes"), 4)


@query("model_group_cv", f"WITH RECURSIVE {SQL_MROWS}, {sql_fit(KFOLD, _configs(BALANCED))} SELECT {RESULT} FROM best_results")
def model_group_cv(spark: SparkSession, sf: str) -> DataFrame:
    return _result(group_cross_validation(_rows(spark, sf), "group_kfold", 5, BALANCED, SPEC).best_t_results)


SQL_GRID_4 = SQL_GRID.replace(", 6)", ", 4)")


@query("model_grid", f"WITH RECURSIVE {SQL_MROWS}, {sql_fit(SHUFFLE, _configs(*CONFIGS))} {SQL_GRID_4}")
def model_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grid_search(_rows(spark, sf), CONFIGS, 30, spec=SPEC).summary, 4)


_TOP = ", ".join(f"{c} DESC" for c in TOP_ORDER)


@query(
    "model_topk_validation",
    f"""WITH RECURSIVE {SQL_MROWS}, {sql_fit(SHUFFLE, _configs(*CONFIGS))}, summary AS ({SQL_GRID.replace("round(", "(").replace(", 6)", ")")}),
top AS (SELECT CAST(row_number() OVER (ORDER BY {_TOP}, config_id) - 1 AS INTEGER) AS place, config_id FROM summary ORDER BY place LIMIT 3),
{sql_fit(KFOLD, "SELECT place, c, balanced FROM top JOIN configs USING (config_id)", "k_")} SELECT {RESULT} FROM k_best_results""",
)
def model_topk_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(_rows(spark, sf))
    return _result(validate_top(rows, grid_search(rows, CONFIGS, 30, spec=SPEC).top, 5, SPEC).best_t_results)


WHOLE = "{p}roled AS (SELECT *, 1 AS split_id, false AS test FROM mrows)"


@query(
    "model_saved_scores",
    f"""WITH RECURSIVE {SQL_MROWS}, {sql_fit(WHOLE, _configs(ModelConfig()))}
SELECT case_id, y AS label, round(CAST(1 AS DOUBLE) / (1 + exp(-(b0 + b1 * (x - mean) / std))), 4) AS score FROM mrows, model WHERE side = 'outer'""",
)
def model_saved_scores(spark: SparkSession, sf: str) -> DataFrame:
    """An MLlib pipeline of all rows, saved, loaded and applied to them."""
    rows, path = cut_lineage(_rows(spark, sf)), f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(final_model(rows, ModelConfig(), SPEC).pipeline(), path)
    scored = load_model(path).transform(rows)
    return scored.select("case_id", "label", F.round(vector_to_array("probability")[1], 4).alias("score"))


@query("run_time_rows", f"WITH {SQL_SIGNALS} SELECT count(*) AS n_rows FROM lsignals")
def run_time_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row count that a run's own write reports; its seconds are left out."""
    df, seen = timed(_rows(spark, sf))
    write_result(df, f"{ensure_checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}")
    return spark.createDataFrame([(runtime_metrics(seen, 1.0)["n_rows"],)], "n_rows bigint")


SQL_PROBE = f"""WITH RECURSIVE {SQL_MROWS},
cut AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('folds|42|0|' || case_id)) AS rn, count(*) OVER (PARTITION BY y) AS n FROM mrows),
folded AS (SELECT x / 1000 AS x, y, 1 + {" + ".join(f"(rn > ceil(CAST({k / 5} AS DOUBLE) * n))::INT" for k in range(1, 5))} AS fold FROM cut),
fold_no AS (SELECT DISTINCT fold FROM folded),
fit AS (
  SELECT fold, 0 AS it, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM fold_no
  UNION ALL
  SELECT fold, it + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT fold, it, b0, b1, sum(p - y) AS g0, sum((p - y) * x) + b1 * 1e-6 AS g1, sum(p * (1 - p)) AS h00,
          sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1e-6 AS h11
        FROM (SELECT f.*, d.x, d.y, CAST(1 AS DOUBLE) / (1 + exp(-(f.b0 + f.b1 * d.x))) AS p FROM fit f JOIN folded d ON d.fold <> f.fold WHERE f.it < 20)
        GROUP BY fold, it, b0, b1)),
cells AS (SELECT fold, {SQL_CELLS} FROM (SELECT d.fold, d.y = 1 AS y, b0 + b1 * x >= 0 AS p FROM folded d JOIN fit f ON f.fold = d.fold AND f.it = 20) GROUP BY fold),
per_fold AS (SELECT fold, {SQL_METRICS} FROM cells)
SELECT count(*) AS n_folds, round(avg(f1), 4) AS f1_mean, round(stddev_pop(f1), 4) AS f1_std FROM per_fold"""


@query("model_shortcut_probe", SQL_PROBE)
def model_shortcut_probe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shortcut_probe(_rows(spark, sf), features=("n_words",)), 4)
