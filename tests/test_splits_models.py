"""Splits and models."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardsift.operators.features import FeatureSpec, class_weights, compress_patterns, fit_preprocessor, preprocessing_stats
from wardsift.operators.joint_fit import JointModel, fit_jointly
from wardsift.operators.models import ModelConfig, fit_logistic, fit_table, score_fits
from wardsift.operators.splits import (
    assign_roles,
    class_shares,
    deal_groups,
    fold_roles,
    group_folds,
    group_shuffle_splits,
    group_sizes,
    group_statistics,
    stratified_folds,
    stratified_split,
    with_signature,
)
from wardsift.operators.validation import cross_fit_both, group_training_set, holdout_training_set
from wardsift.plans.train import final_model, grid_search, group_cross_validation, parameter_grid, shortcut_probe, single_run, validate_top
from wardsift.sources.tables import load_model, save_model

SPEC = FeatureSpec()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def signals(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        rf, mi = rng.choice([0, 0, 0, 1, 2, 3]), rng.randint(0, 3)
        severity = rng.choice(["low", "medium", "high"])
        risk = 0.9 * rf + (severity == "high") - 1.2 - 0.2 * mi
        label = int(rng.random() < 1 / (1 + math.exp(-risk)))
        confidence = [0.9, 0.75, 0.5, 0.35][mi] - 0.05 * (rf % 2)
        data.append(
            (i, confidence, rf, mi, severity, ["low", "medium", "high", "high"][mi], rng.choice(["clear", "ambiguous"]), rng.choice(["a", "b", "c"]), label)
        )
    schema = (
        "case_id long, confidence double, n_risk_factors int, n_missing_information int, severity string, "
        "uncertainty_level string, clarity string, domain string, label int"
    )
    return spark.createDataFrame(data, schema).cache()


@pytest.fixture(scope="module")
def groups(spark):
    # One group with 90 % of the rows, many singles.
    sizes = [("hot", 900)] + [(f"g{i}", 1) for i in range(60)] + [(f"m{i}", 8) for i in range(5)]
    return spark.createDataFrame(sizes, "group_key string, size long")


def test_stratified_quota_is_exact_and_stable(spark, signals):
    one = stratified_split(signals.repartition(1), "case_id")
    counts = {(r["label"], r["role"]): r["count"] for r in one.groupBy("label", "role").count().collect()}
    for label in (0, 1):
        n = counts[(label, "test")] + counts[(label, "train")]
        assert counts[(label, "test")] == math.ceil(0.2 * n)
    many = stratified_split(signals.repartition(17), "case_id")
    assert rows(one.select("case_id", "role")) == rows(many.select("case_id", "role"))
    other = stratified_split(signals, "case_id", seed=7)
    assert rows(one.select("case_id", "role")) != rows(other.select("case_id", "role"))


def test_hash_draw_is_near_the_share(signals):
    share = stratified_split(signals, "case_id", exact=False).agg(F.avg((F.col("role") == "test").cast("int"))).first()[0]
    assert 0.12 < share < 0.28


def test_stratified_folds_partition_each_class(signals):
    folds = stratified_folds(signals, "case_id", n_folds=5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_group_shuffle_quota_and_disjoint(groups):
    roles = group_shuffle_splits(groups, 4, 0.2).cache()
    n = groups.count()
    per_split = roles.filter("role = 'test'").groupBy("split_id").count().collect()
    assert {r["count"] for r in per_split} == {math.ceil(0.2 * n)} and len(per_split) == 4
    assert roles.count() == 4 * n == roles.select("split_id", "group_key").distinct().count()
    tests = {s: frozenset(r[0] for r in roles.filter(f"role = 'test' AND split_id = {s}").select("group_key").collect()) for s in range(1, 5)}
    assert len(set(tests.values())) == 4
    with pytest.raises(ValueError):
        group_shuffle_splits(groups, None)


def _greedy(sizes, k):
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


@pytest.mark.parametrize("seed", range(30))
def test_dealing_by_histogram_equals_dealing_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 40, 500]) for _ in range(rng.randint(5, 200))]
    k = rng.randint(2, 7)
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    dealt = deal_groups(histogram, k)
    assert {s: sum(c) for s, c in dealt.items()} == dict(histogram)
    assert [sum(s * dealt[s][f] for s in dealt) for f in range(k)] == _greedy(sizes, k)


def test_dealing_many_single_groups_is_fast():
    assert deal_groups([(10**12, 1), (1, 10**9)], 5)[1][0] == 0


def test_group_folds(groups):
    folds = group_folds(groups, 5).cache()
    assert folds.count() == groups.count() == folds.select("group_key").distinct().count()
    loads = {r["fold"]: r["n"] for r in folds.groupBy("fold").agg(F.sum("size").alias("n")).collect()}
    assert sorted(loads.values()) == [25, 25, 25, 25, 900]
    assert rows(folds) == rows(group_folds(groups.repartition(13), 5))
    roles = fold_roles(folds, 5)
    assert roles.filter("role = 'test'").count() == groups.count()
    for bad in (None, 0):
        with pytest.raises(ValueError):
            group_folds(groups, bad)
    with pytest.raises(ValueError):
        group_folds(groups.limit(3), 5)


def test_one_group_cannot_be_folded(spark):
    with pytest.raises(ValueError):
        group_folds(spark.createDataFrame([("only", 10)], "group_key string, size long"), 2)


def test_group_statistics(groups):
    r = group_statistics(groups).first()
    assert r["n_groups"] == 66 and r["p50"] == 1.0 and r["max"] == 900.0


def test_rows_of_a_group_stay_together(signals):
    signed = with_signature(signals, SPEC.columns)
    sizes = group_sizes(signed)
    assigned = assign_roles(signed, group_shuffle_splits(sizes, 3)).cache()
    sides = assigned.groupBy("split_id", "group_key").agg(F.countDistinct("role").alias("n"))
    assert sides.filter("n > 1").count() == 0 and assigned.count() == 3 * signals.count()
    shares = class_shares(assigned).groupBy("split_id", "role").agg(F.sum("share").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in shares)


def test_preprocessor(signals):
    patterns = compress_patterns(signals, SPEC)
    assert patterns.agg(F.sum("weight")).first()[0] == 600
    prep = fit_preprocessor(patterns)
    values = [r[0] for r in signals.select("n_risk_factors").collect()]
    assert prep.means["n_risk_factors"] == pytest.approx(np.mean(values))
    assert prep.stds["n_risk_factors"] == pytest.approx(np.std(values))
    assert prep.feature_names[3:] == [
        "severity_low", "severity_medium", "uncertainty_level_low", "uncertainty_level_medium", "clarity_clear", "domain_b", "domain_c",
    ]
    new = signals.limit(1).withColumns({"domain": F.lit("unseen"), "severity": F.lit(None).cast("string")})
    encoded = prep.transform(new).select("domain_b", "domain_c", "severity_low").first()
    assert tuple(encoded) == (0.0, 0.0, 0.0)


def test_constant_feature_is_not_divided_by_zero(spark, signals):
    flat = compress_patterns(signals.withColumn("confidence", F.lit(0.5)))
    prep = fit_preprocessor(flat)
    assert prep.stds["confidence"] == 0.0
    assert prep.transform(flat).agg(F.max("confidence")).first()[0] == 0.0


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert rows(class_weights(df)) == [(0, 6, 8 / 12), (1, 2, 2.0)]


def _solve(x, y, w, c, l1, penalise_intercept=True, steps=200_000):
    """Independent solver: proximal gradient with acceleration on the summed loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pen = np.ones(x.shape[1])
    pen[-1] = float(penalise_intercept)
    lip = c * np.linalg.norm((x * w[:, None] * 0.25).T @ x, 2) + 1.0
    beta, z, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ z))
        grad = c * x.T @ (w * (p - y)) + (1 - l1) * pen * z
        new = z - grad / lip
        new = np.sign(new) * np.maximum(np.abs(new) - l1 * pen / lip, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - beta)
        if np.max(np.abs(new - beta)) < 1e-12:
            break
        beta, t = new, t2
    return beta


CONFIGS = [
    ModelConfig(C=c, l1_ratio=r, class_weight=w) for c, r, w in itertools.product([0.01, 1.0], [0.0, 1.0], [None, "balanced"])
]


@pytest.fixture(scope="module")
def marked(signals):
    patterns = compress_patterns(signals, SPEC)
    return patterns.withColumns({"test_in": F.array().cast("array<int>"), "held": F.array().cast("array<bigint>")}).cache()


def test_joint_fit_reaches_the_optimum(marked):
    fitted = fit_jointly(marked, SPEC, [1], [JointModel(c, 1) for c in CONFIGS])
    prep = fitted[0].preprocessor
    table = prep.transform(marked.withColumn("y", F.col("label"))).select(*prep.feature_names, "y", "weight").toPandas()
    x, y, n = table[prep.feature_names].to_numpy(), table["y"].to_numpy(), table["weight"].to_numpy(dtype=float)
    for config, model in zip(CONFIGS, fitted, strict=True):
        w = n.copy()
        if config.class_weight:
            for label in (0, 1):
                w[y == label] *= n.sum() / (2 * n[y == label].sum())
        want = _solve(x, y, w, config.C, config.l1_ratio)
        assert [*model.coefficients, model.intercept] == pytest.approx(want.tolist(), abs=2e-5), config


@pytest.mark.parametrize("config", [CONFIGS[3], CONFIGS[4], ModelConfig(penalise_intercept=False)])
def test_single_fit_agrees_with_joint_fit(marked, config):
    joint = fit_jointly(marked, SPEC, [1], [JointModel(config, 1)])[0]
    single = fit_logistic(marked, fit_preprocessor(marked), config)
    assert joint.preprocessor.means == pytest.approx(single.preprocessor.means)
    assert joint.preprocessor.stds == pytest.approx(single.preprocessor.stds)
    assert [*joint.coefficients, joint.intercept] == pytest.approx([*single.coefficients, single.intercept], abs=2e-4)


def test_splits_use_their_own_statistics(signals):
    data = group_training_set(signals, SPEC, "group_kfold", 3)
    fits, inner = cross_fit_both(data, [ModelConfig()])
    stats = {r["split_id"]: r for r in preprocessing_stats(data.train_rows(), SPEC, ["split_id"]).collect()}
    for (_, split), model in fits.items():
        assert model.preprocessor.means["n_risk_factors"] == pytest.approx(stats[split]["_mean_n_risk_factors"])
        assert model.preprocessor.stds["confidence"] == pytest.approx(stats[split]["_std_confidence"])
        assert model.preprocessor.categories["domain"] == list(stats[split]["_levels_domain"])
    alone = fit_jointly(data.table, SPEC, data.split_ids, [JointModel(ModelConfig(), 2, inner=True)])[0]
    assert list(inner[(0, 2)].coefficients) == pytest.approx(list(alone.coefficients))


def test_missing_category_in_a_train_side(spark, signals):
    """The first category that the train side holds is the dropped one; the absent one has no weight."""
    marked = compress_patterns(signals, SPEC).withColumns(
        {"test_in": F.when(F.col("domain") == "a", F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), "held": F.array().cast("array<bigint>")}
    )
    model = fit_jointly(marked, SPEC, [1], [JointModel(ModelConfig(), 1)])[0]
    assert model.preprocessor.categories["domain"] == ["b", "c"]
    assert "domain_b" not in model.preprocessor.feature_names and len(model.coefficients) == len(model.preprocessor.feature_names)
    scored = score_fits(marked.withColumn("split_id", F.lit(1)), fit_table(spark, {(0, 1): model})).filter("domain = 'a'")
    assert scored.count() > 0 and scored.filter("score IS NULL").count() == 0


def test_scores_equal_the_saved_pipeline(spark, signals, tmp_path):
    model = final_model(signals)
    save_model(model.pipeline(), str(tmp_path / "model"))
    applied = {r.case_id: r.p for r in signals.select("case_id", model.probability().alias("p")).collect()}
    unseen = signals.limit(1).selectExpr("* EXCEPT (severity)", "'never seen' AS severity").unionByName(signals.limit(1).selectExpr("* EXCEPT (severity)", "CAST(NULL AS STRING) AS severity"))
    assert all(0 < r.p < 1 for r in unseen.select(model.probability().alias("p")).collect())
    ml = load_model(str(tmp_path / "model")).transform(signals).select("case_id", vector_to_array("probability")[1].alias("p"))
    own = score_fits(signals.withColumn("split_id", F.lit(1)), fit_table(spark, {(0, 1): model}))
    worst = own.join(ml, "case_id").agg(F.max(F.abs(F.col("p") - F.col("score")))).first()[0]
    assert worst < 1e-9


def test_training_sets(signals):
    data = holdout_training_set(signals)
    assert data.table.agg(F.sum("weight")).first()[0] == 600
    assert data.test_rows().agg(F.sum("weight")).first()[0] == sum(
        math.ceil(0.2 * r["count"]) for r in signals.groupBy("label").count().collect()
    )
    with pytest.raises(ValueError):
        group_training_set(signals, SPEC, "random", 3)


def test_single_run(signals):
    run = single_run(signals)
    best = run.metrics_at_best.first()
    assert 0.5 < best["roc_auc"] <= 1 and best["n_test"] == run.report.filter("class = 'accuracy'").first()["support"]
    assert run.thresholds.count() == 101
    assert run.coefficients.first()["coef"] == max(r["coef"] for r in run.coefficients.collect())
    assert run.scored.agg(F.sum("weight")).first()[0] == best["n_test"]


def test_cross_validation_search_and_top(signals):
    cv = group_cross_validation(signals, "group_kfold", 3)
    results = cv.results.collect()
    assert sorted(r["split_id"] for r in results) == [1, 2, 3] and sum(r["n_test"] for r in results) == 600
    assert cv.summary.count() == 10 and cv.best_t_results.count() == 3 and cv.thresholds.count() == 303
    grid = grid_search(signals, parameter_grid(c=(0.01, 1.0), l1_ratio=(0.0, 1.0), class_weight=(None,)), n_splits=3, top_k=2)
    assert grid.summary.count() == 4 and grid.results.count() == 12
    top = grid.top.collect()
    assert len(top) == 2 and top[0]["q25_f2"] >= top[1]["q25_f2"]
    checked = validate_top(signals, grid.top, n_folds=3)
    assert checked.best_t_results.count() == 6


def test_shortcut_probe(spark, signals):
    metrics = signals.select("case_id", "label", *[(F.col("n_risk_factors") * k + 1).cast("double").alias(n) for k, n in enumerate(
        ["n_words", "n_chars", "n_sentences", "digit_ratio", "upper_ratio", "punct_ratio"])])
    r = shortcut_probe(metrics).first()
    assert r["n_folds"] == 5 and 0 < r["f1_mean"] < 1 and r["f1_std"] >= 0


def test_folds_fitted_together_equal_single_fits_and_stay_in_the_jvm(spark, signals):
    from wardsift.operators.features import Preprocessor
    from wardsift.operators.fold_fits import fit_folds

    names = ["n_risk_factors", "n_missing_information", "large"]
    table = stratified_folds(signals.withColumn("large", F.col("case_id") * 1000.0), "case_id", "label", 3).withColumn("weight", F.lit(1)).select(*names, "label", "weight", "fold")
    table = table.unionByName(table.limit(5).withColumn("weight", F.lit(4))).cache()
    together = fit_folds(table, names, 3)
    plain = Preprocessor(FeatureSpec(tuple(names), ()), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0))
    for f, model in together.items():
        alone = fit_logistic(table.filter(F.col("fold") != f), plain, ModelConfig(penalise_intercept=False))
        probabilities = table.select(F.abs(model.probability() - alone.probability()).alias("d"))
        assert probabilities.agg(F.max("d")).first()[0] < 1e-4 and model.converged
    with pytest.raises(ValueError, match="have not converged"):
        fit_folds(table, names, 3, ModelConfig(penalise_intercept=False, max_iter=1))
    with pytest.raises(ValueError, match="L2"):
        fit_folds(table, names, 3, ModelConfig(l1_ratio=1.0, penalise_intercept=False))
    metrics = signals.select("case_id", "label", *[F.col("n_risk_factors").cast("double").alias(n) for n in ("n_words", "n_chars", "n_sentences", "digit_ratio", "upper_ratio", "punct_ratio")])
    assert "MapInPandas" not in shortcut_probe(metrics)._jdf.queryExecution().toString()


def _small_training(spark):
    rows = [(i, 0.1 * (i % 7), i % 3, i % 2, "low" if i % 4 else "high", "medium", "clear", "en", int((i * 7) % 5 > 2)) for i in range(60)]
    return spark.createDataFrame(
        rows,
        "case_id long, confidence double, n_risk_factors long, n_missing_information long, severity string, "
        "uncertainty_level string, clarity string, domain string, label int",
    )


def test_a_fit_that_stops_early_raises_or_is_flagged(spark):
    from wardsift.operators.joint_fit import JointModel, fit_jointly
    from wardsift.operators.models import ModelConfig, coefficient_table
    from wardsift.operators.validation import holdout_training_set

    data = holdout_training_set(_small_training(spark))
    models = [JointModel(ModelConfig(max_iter=1), 1), JointModel(ModelConfig(), 1)]
    with pytest.raises(ValueError, match="1 models have not converged"):
        fit_jointly(data.table, data.spec, data.split_ids, models)
    short, whole = fit_jointly(data.table, data.spec, data.split_ids, models, strict=False)
    assert (short.converged, short.passes) == (False, 1) and whole.converged and whole.passes > 1
    flags = {r.config_id: r.converged for r in coefficient_table(spark, {(0, 1): short, (1, 1): whole}).collect()}
    assert flags == {0: False, 1: True}


def test_null_features_and_too_many_levels_are_named(spark):
    from pyspark.sql import functions as F

    from wardsift.operators.features import FeatureSpec, check_features, fit_preprocessor
    from wardsift.operators.joint_fit import JointModel, fit_jointly
    from wardsift.operators.models import ModelConfig
    from wardsift.operators.validation import holdout_training_set

    rows = _small_training(spark).withColumn("confidence", F.when(F.col("case_id") != 5, F.col("confidence")))
    data = holdout_training_set(rows)
    with pytest.raises(ValueError, match="confidence"):
        fit_jointly(data.table, data.spec, data.split_ids, [JointModel(ModelConfig(), 1)])
    with pytest.raises(ValueError, match="confidence"):
        fit_preprocessor(rows.withColumn("weight", F.lit(1)))
    wide = _small_training(spark).withColumn("domain", F.col("case_id").cast("string"))
    with pytest.raises(ValueError, match="domain"):
        check_features(wide, FeatureSpec(), 10)
