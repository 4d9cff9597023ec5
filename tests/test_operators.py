"""Operators against brute force on small tables."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardsift.operators.curves import (
    best_threshold,
    curve_areas,
    curve_points,
    roc_points,
    score_counts,
    threshold_sweep,
)
from wardsift.operators.decisions import (
    decide,
    disagreement,
    error_profile,
    errors,
    match_rules,
    sorted_profile,
    with_label_texts,
)
from wardsift.operators.distribution import describe, describe_levels, value_bin
from wardsift.operators.evaluation import classification_report, confusion, with_binary_metrics
from wardsift.operators.frames import (
    check_same_columns,
    compare_runs,
    compute_once,
    drop_columns,
    integrity,
    merge_runs,
    rename_by_split,
    sort_top_k,
)
from wardsift.operators.profile import duplicate_rate, extreme_flags, extreme_rates, sample_heads, sanity_profile
from wardsift.operators.summaries import cv_summary, defined_splits, grid_summary
from wardsift.operators.vocabulary import extreme_log_odds, log_odds, top_tokens, with_marker_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    # One group holds most rows, one value most of that group.
    data = [("hot", 5.0 if rng.random() < 0.6 else rng.lognormvariate(3, 2)) for _ in range(3000)]
    data += [("cold", rng.uniform(-3, 3)) for _ in range(101)] + [("one", 7.0), ("cold", None)]
    return data, spark.createDataFrame(data, "g string, v double")


def test_describe_equals_numpy(numbers):
    data, df = numbers
    got = {r["g"]: r for r in describe(df, ["v"], ["g"], digits=None).collect()}
    for group in ("hot", "cold", "one"):
        values = [v for g, v in data if g == group and v is not None]
        r = got[group]
        assert r["count"] == len(values)
        assert r["mean"] == pytest.approx(np.mean(values), rel=1e-12)
        assert (r["min"], r["max"]) == (min(values), max(values))
        if len(values) > 1:
            assert r["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)
        else:
            assert r["std"] is None
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(np.percentile(values, [25, 50, 75]).tolist(), rel=1e-12)


def test_describe_does_not_depend_on_partitions(numbers):
    _, df = numbers
    one, many = (describe(df.repartition(n), ["v"], ["g"]) for n in (1, 17))
    assert rows(one) == rows(many)


def test_describe_levels(numbers):
    data, df = numbers
    got = describe_levels(df, ["v"], [[], ["g"]], digits=None).collect()
    overall = [r for r in got if r["level"] == "overall"]
    values = [v for _, v in data if v is not None]
    assert len(overall) == 1 and len(got) == 4
    assert [overall[0][c] for c in ("p1", "p5", "p50", "p95", "p99")] == pytest.approx(
        np.percentile(values, [1, 5, 50, 95, 99]).tolist()
    )


def test_value_bin_never_decreases(spark):
    values = sorted(random.Random(2).lognormvariate(0, 8) * random.choice((-1, 1)) for _ in range(5000))
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(value_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


def test_extremes(spark):
    data = [(i, n, n * 5) for i, n in enumerate([0, 1, 3, 4, *range(10, 106)])]
    df = spark.createDataFrame(data, "case_id int, n_words int, n_chars int")
    cut = np.percentile([d[1] for d in data], 99)
    flagged = extreme_flags(df)
    assert {r["case_id"] for r in flagged.filter("is_huge").collect()} == {i for i, n, _ in data if n >= cut}
    assert {r["case_id"] for r in flagged.filter("is_tiny").collect()} == {0, 1, 2}
    rate = extreme_rates(df).first()
    assert rate["rate_empty"] == 0.01 and rate["rate_tiny"] == 0.03
    assert rate["rate_huge"] == sum(n >= cut for _, n, _ in data) / 100
    heads = sample_heads(flagged, {"is_empty": 10, "is_tiny": 2}, ["n_words"])
    assert rows(heads.select("flag", "case_id")) == [("is_empty", 0), ("is_tiny", 0), ("is_tiny", 1)]


def test_sanity_profile(spark):
    df = spark.createDataFrame([("", "a"), (None, "a"), ("x", None), ("y", "b")], "report_text string, expected_action string")
    got = {r["expected_action"]: r for r in sanity_profile(df).collect()}
    assert {k: r["n_label"] for k, r in got.items()} == {"a": 2, None: 1, "b": 1}
    assert got["a"]["mean_null_text"] == 0.25 and got["a"]["mean_empty_text"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        sanity_profile(df, label_col="nope")


def test_duplicate_rate(spark):
    df = spark.createDataFrame([("A",), (" a ",), ("b",), ("a",)], "report_text string")
    assert tuple(duplicate_rate(df).first()) == (4, 2, 0.5)


def test_top_tokens_ties_by_token(spark):
    df = spark.createDataFrame([("g", "bb aa bb cc aa dd"), ("h", "zz")], "k string, report_text string")
    got = top_tokens(df, ["k"], 3).select("k", "token", "n", "rank")
    assert rows(got) == [("g", "aa", 2, 1), ("g", "bb", 2, 2), ("g", "cc", 1, 3), ("h", "zz", 1, 1)]


def test_log_odds(spark):
    df = spark.createDataFrame([(True, "aa aa bb"), (False, "bb cc"), (None, "dd")], "s boolean, report_text string")
    got = {r["token"]: r["log_odds"] for r in log_odds(df, F.col("s")).collect()}
    assert set(got) == {"aa", "bb", "cc"}
    assert got["aa"] == pytest.approx(math.log((3 / 4) / (1 / 3)))
    top = extreme_log_odds(log_odds(df, F.col("s")), 1)
    assert {(r["side"], r["token"]) for r in top.collect()} == {("top", "aa"), ("bottom", "cc")}


def test_marker_counts(spark):
    df = spark.createDataFrame([("Not now, never; must it? no no",)], "report_text string")
    assert tuple(with_marker_counts(df).first())[1:] == (4, 1)


def test_match_rules(spark):
    df = spark.createDataFrame([(1, "Akute BLUTUNG und Fieber"), (2, "Fiebersenkung")], "case_id int, report_text string")
    got = {r["case_id"]: r for r in match_rules(df).collect()}
    assert [tuple(h) for h in got[1]["hits"]] == [("sepsis", "fieber"), ("bleeding", "blutung")]
    assert got[1]["expected_action_rule"] and not got[2]["expected_action_rule"]


def test_errors_and_profile(spark):
    data = [
        ("escalation", False, "low", 1),
        ("escalation", False, "low", 1),
        ("no_escalation", True, "high", None),
        ("escalation", True, "low", 1),
    ]
    df = spark.createDataFrame(data, "expected_action string, p boolean, severity string, n int")
    wrong = errors(df, "p")
    assert wrong.count() == 3 and errors(df, "p", kind="false_positive").count() == 1
    profile = sorted_profile(error_profile(wrong.withColumnRenamed("n", "k"), ["severity", "k"]), ["severity", "k"])
    assert rows(profile) == [("false_negative", "low", 1, 2)]
    assert with_label_texts(df, ["p", "severity"]).first()["p"] == "no_escalation"


def test_decide_baseline_changes_nothing(spark):
    df = spark.createDataFrame(
        [(True, "low", "low", 0.1, 0, 0)],
        "expected_action_llm boolean, severity string, uncertainty_level string, confidence double, n_risk_factors int, n_missing_information int",
    )
    once = decide(df, "baseline")
    twice = decide(once, "baseline", action_col="expected_action_final")
    assert rows(once) == rows(twice)


def test_disagreement_is_null_safe(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", None), (3, None, None)], "k int, l string, r string")
    assert rows(disagreement(df, "l", "r", ["k"])) == [(2,)]


def test_frames(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "c"])
    assert rename_by_split(df).columns == ["a", "c"]
    with pytest.raises(ValueError, match="clash"):
        rename_by_split(spark.createDataFrame([(1, 2)], ["a  b", "a c"]))
    assert drop_columns(df, ["c", "zz"]).columns == ["a b"]
    with pytest.raises(ValueError):
        drop_columns(df, ["zz"], strict=True)
    with pytest.raises(ValueError):
        check_same_columns(df, df.select("c"))
    assert rows(compute_once(df, {"d": F.lit(5), "c": F.lit(9)})) == [(1, 5, 9)]


def test_merge_and_compare_runs(spark):
    runs = [spark.createDataFrame([(1, i, f"r{i}"), (2, i, f"s{i}")], "k int, x int, p string") for i in range(4)]
    merged = merge_runs(runs, "k", drop=["x"])
    assert merged.columns == ["k", "p_0", "p_1", "p_2", "p_3"]
    assert rows(merged) == [(1, "r0", "r1", "r2", "r3"), (2, "s0", "s1", "s2", "s3")]
    side = compare_runs({"a": runs[0], "b": runs[1].filter("k = 1")}, ["k"], "p")
    assert rows(side) == [(1, "r0", "r1"), (2, "s0", None)]
    with pytest.raises(ValueError):
        merge_runs(runs, [])
    with pytest.raises(ValueError):
        merge_runs([runs[0], runs[1].drop("k")], "k")


def test_sort_top_k_breaks_ties(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0), (1, 1.0, 1.0), (2, 2.0, 0.0)], "id int, a double, b double")
    _, top = sort_top_k(df, ["a", "b"], ["id"], 2, tie_break="id")
    assert [r[0] for r in top.collect()] == [2, 1]


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, None), (2, "b")], "k int, v string")
    assert tuple(integrity(df, "k", ["v"]).first()) == (4, 1, 1)
    with pytest.raises(ValueError):
        integrity(df, "k", ["w"])


# Confusion (tn, fp, fn, tp) by hand: no positives, no negatives, nothing right, usual.
@pytest.mark.parametrize("cells", [(5, 2, 0, 0), (0, 0, 3, 4), (0, 3, 2, 0), (4, 1, 2, 3)])
def test_metrics_from_counts(spark, cells):
    tn, fp, fn, tp = cells
    data = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    counts = confusion(spark.createDataFrame(data, "label int, prediction int"))
    m = with_binary_metrics(counts).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == cells

    def div(a, b):
        return a / b if b else 0.0

    p, r = div(tp, tp + fp), div(tp, tp + fn)
    assert (m["precision"], m["recall"]) == (p, r)
    assert m["f1"] == pytest.approx(div(2 * p * r, p + r))
    assert m["f2"] == pytest.approx(div(5 * p * r, 4 * p + r))
    report = {r["class"]: r for r in classification_report(counts).collect()}
    assert report["no_escalation"]["precision"] == div(tn, tn + fn)
    assert report["accuracy"]["f1"] == pytest.approx((tn + tp) / sum(cells))
    assert report["macro avg"]["recall"] == pytest.approx((r + div(tn, tn + fp)) / 2)
    assert report["weighted avg"]["support"] == sum(cells)


def test_published_agreement_table(spark):
    """Known counts of a 320-report run give its published quality."""
    counts = spark.createDataFrame([(4, 156, 1, 159)], "tn long, fp long, fn long, tp long")
    m = with_binary_metrics(counts).first()
    assert [round(m[c], 4) for c in ("precision", "recall", "f2")] == [0.5048, 0.9938, 0.8325]


def _scored(spark, seed=3, n=800):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        s = 0.37 if rng.random() < 0.4 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2)
        data.append(("hot" if rng.random() < 0.7 else "cold", y, s))
    return data, spark.createDataFrame(data, "g string, label int, score double")


def _auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def _ap(pairs):
    total, out, before = sum(y for y, _ in pairs), 0.0, 0.0
    for t in sorted({s for _, s in pairs}, reverse=True):
        chosen = [y for y, s in pairs if s >= t]
        out += (sum(chosen) / total - before) * sum(chosen) / len(chosen)
        before = sum(chosen) / total
    return out


def test_areas_equal_their_definition(spark):
    data, df = _scored(spark)
    points = curve_points(score_counts(df, ["g"]), ["g"])
    for r in curve_areas(points, ["g"]).collect():
        pairs = [(y, s) for g, y, s in data if g == r["g"]]
        assert r["roc_auc"] == pytest.approx(_auc(pairs)) and r["pr_auc"] == pytest.approx(_ap(pairs))


@pytest.mark.parametrize("labels, roc, pr", [([1, 1, 1], None, 1.0), ([0, 0, 0], None, 0.0), ([1, 0, 1], 0.5, 2 / 3)])
def test_areas_with_one_class_or_tied_scores(spark, labels, roc, pr):
    df = spark.createDataFrame([(y, 0.5) for y in labels], "label int, score double")
    r = curve_areas(curve_points(score_counts(df))).first()
    assert r["roc_auc"] == roc and r["pr_auc"] == pytest.approx(pr)


def test_curves_do_not_depend_on_partitions(spark):
    _, df = _scored(spark)
    one, many = (rows(roc_points(curve_points(score_counts(df.repartition(n))))) for n in (1, 17))
    assert one == many


def test_sweep_equals_brute_force(spark):
    data, df = _scored(spark)
    got = {(r["g"], round(r["threshold"], 2)): r for r in threshold_sweep(df, ["g"]).collect()}
    assert len(got) == 202
    for g in ("hot", "cold"):
        pairs = [(y, s) for k, y, s in data if k == g]
        for i in range(101):
            t = i * 0.01
            tp = sum(y for y, s in pairs if s >= t)
            chosen = sum(1 for _, s in pairs if s >= t)
            r = got[(g, round(t, 2))]
            assert r["n_test"] == len(pairs) and r["n_pos"] == sum(y for y, _ in pairs)
            assert r["precision"] == pytest.approx(tp / chosen if chosen else 0.0)
            assert r["recall"] == pytest.approx(tp / r["n_pos"])


def test_best_threshold_takes_the_lowest_of_a_tie(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.1)], "label int, score double")
    assert best_threshold(threshold_sweep(df)).first()["threshold"] == pytest.approx(0.11)
    with pytest.raises(ValueError):
        best_threshold(threshold_sweep(df), metric="accuracy")


def test_weighted_sweep_and_counts(spark):
    data, df = _scored(spark, n=300)
    packed = df.groupBy("g", "label", "score").agg(F.count(F.lit(1)).alias("w"))
    assert rows(threshold_sweep(df, ["g"])) == rows(threshold_sweep(packed, ["g"], weight_col="w"))
    assert rows(score_counts(df)) == rows(score_counts(packed, weight_col="w"))


CV_ROWS = [(i, 80 + i, f"{0.2 + i / 1000}", None if i == 4 else 0.5 + i / 40, 0.3 + i / 50) for i in range(12)]


def test_cv_summary(spark):
    df = spark.createDataFrame(CV_ROWS, "split int, n_test int, part_test string, roc_auc double, f2 double")
    got = {r["metric"]: r for r in cv_summary(df, columns=["n_test", "part_test", "roc_auc", "f2"]).collect()}
    roc = [r[3] for r in CV_ROWS if r[3] is not None]
    assert got["roc_auc"]["count"] == 11 and got["roc_auc"]["std"] == pytest.approx(statistics.stdev(roc))
    q = np.percentile(roc, [5, 10, 25, 50, 75, 90, 95])
    assert [got["roc_auc"][c] for c in ("q5", "q10", "q25", "median", "q75", "q90", "q95")] == pytest.approx(q.tolist())
    assert got["f2"]["IQR"] == pytest.approx(np.subtract(*np.percentile([r[4] for r in CV_ROWS], [75, 25])))
    assert got["part_test"]["max"] == pytest.approx(0.211)
    assert tuple(defined_splits(df).first()) == (11, 12)


def test_grid_summary_uses_population_deviation(spark):
    data = [(c, 1.0, 0.0, "None", s, 0.1 * s, 0.5, 0.4, 0.3, 0.2) for c in range(2) for s in range(5)]
    schema = "config_id int, C double, l1_ratio double, class_weight string, s int, f2 double, pr_auc double, precision double, recall double, best_t double"
    df = spark.createDataFrame(data, schema)
    r = grid_summary(df).filter("config_id = 0").first()
    values = [0.1 * s for s in range(5)]
    assert r["std_f2"] == pytest.approx(statistics.pstdev(values))
    assert [r["mean_f2"], r["min_f2"], r["q10_f2"], r["q25_f2"]] == pytest.approx([0.2, 0.0, 0.04, 0.1])
    _, top = sort_top_k(grid_summary(df), ["q25_f2", "median_f2", "mean_f2"], ["config_id"], 1, tie_break="config_id")
    assert top.first()[0] == 0
