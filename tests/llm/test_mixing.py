import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardsift.llm import op9_mixing
from wardsift.llm.op9_mixing import DOMAINS, TARGETS, fit_classifier, fit_rates, label_domains, mixing_rates, posteriors, rates, with_rates


def made(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices([0, 1, 2], [0.6, 0.2, 0.2])[0]
        ws = rng.choices([f"w{j}" for j in range(50)], k=rng.randint(5, 120))
        if kind == 1:
            ws = [w + "%%%" for w in ws]
        if kind == 2:
            ws[rng.randrange(len(ws))] = rng.choice(["scum", "trash"])
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, DOMAINS[kind]))
    return rows, labels


def test_rates_meet_targets_and_equal_the_least_squares_solution(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.2, 0.2], 500)
    t = rng.integers(0, 300, 500)
    known = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double").repartition(3)
    fitted = fit_rates(known, ridge=1e-2, tolerance=1e-4, max_steps=80)
    got = rates(p, *fitted)[0]
    want = np.array([TARGETS[d] for d in DOMAINS])
    r = np.ones(500)
    for _ in range(20000):  # plain projected gradient to the end
        r = np.maximum(0, r - 0.5 * (p @ ((t * r) @ p / t.sum() - want) + 1e-2 * (r - 1)))
    assert (got >= 0).all() and (r == 0).sum() > 10
    assert np.abs(got - r)[t > 0].max() < 2e-2
    tight = rates(p, *fit_rates(known, tolerance=2e-3, max_steps=80))[0]
    assert np.abs((t * tight) @ p / t.sum() - want).max() < 2e-3


def test_classifier_on_held_out_rows(spark):
    rows, labels = made(900, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    known = spark.createDataFrame(labels, "doc_id long, domain string")
    fitted = fit_classifier(docs.where("doc_id < 700"), known, min_rows=5)
    p = posteriors(docs.where("doc_id >= 700"), fitted).toPandas()
    best = p[["p0", "p1", "p2"]].to_numpy().argmax(axis=1)
    assert np.mean([DOMAINS[b] == labels[i][1] for b, i in zip(best, p.id)]) > 0.9


def test_infeasible_targets_end(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    got = mixing_rates(docs, spark.createDataFrame([], "doc_id long, domain string"), max_steps=5).collect()
    assert all(r.rate >= 0 and r.p_good == pytest.approx(1 / 3) for r in got)


def test_empty_table_nulls_and_clashing_columns(spark):
    labels = label_domains(spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert labels.where("doc_id is not null").count() == 3
    schema = "doc_id long, text string, rate string, domain string"
    assert mixing_rates(spark.createDataFrame([], schema), labels).count() == 0
    rows = [(None, "a b", "r", "d"), (1, None, None, None), (1, "", "r", "d"), (2, "x " * 4000, "r", "d")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.n_tokens for r in mixing_rates(docs, labels).collect()) == [0, 0, 2, 4000]
    mixed = with_rates(docs, labels)
    assert mixed.columns == [*docs.columns, "mix_rate"]
    assert sorted(map(str, mixed.drop("mix_rate").collect())) == sorted(map(str, docs.collect()))
    assert mixed.where(F.col("mix_rate").isNull()).count() == 0


def test_rare_domain_reaches_its_target_by_default(spark):
    rng = np.random.default_rng(8)
    kind = rng.choice(3, 20_000, p=[0.699, 0.3, 0.001])
    logits = rng.normal(0, 1, (20_000, 3)) + 6 * np.eye(3)[kind] + np.log([0.699, 0.3, 0.001])
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    t = rng.integers(1, 300, 20_000)
    known = spark.createDataFrame(pd.DataFrame({"n_tokens": t, "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})).repartition(4)
    want = np.array([TARGETS[d] for d in DOMAINS])
    fitted = op9_mixing.fit_targets(known)
    shares = (t * rates(p, *fitted)[0]) @ p / t.sum()
    assert fitted.met and fitted.reached == pytest.approx(shares)
    assert np.abs(shares - want).max() < 1e-3


def test_unfinished_fit_raises_and_missed_targets_warn(spark):
    known = spark.createDataFrame([(100, 0.7, 0.2, 0.1), (50, 0.1, 0.8, 0.1), (70, 0.2, 0.1, 0.7)], "n_tokens long, p0 double, p1 double, p2 double")
    with pytest.raises(ValueError, match="not converged"):
        fit_rates(known, max_steps=1)
    only = known.where("n_tokens = 100")
    with pytest.warns(RuntimeWarning, match="not met"):
        fitted = op9_mixing.fit_targets(only)
    assert not fitted.met
    p, want = np.array([0.7, 0.2, 0.1]), np.array([TARGETS[d] for d in DOMAINS])
    assert rates(p[None], *fitted)[0][0] == pytest.approx((p @ want + 1e-4) / (p @ p + 1e-4), abs=1e-4)
