"""Optimality certificates of jointly fitted models."""

import dataclasses
import math
import random

import pytest

from wardsift.operators.features import FeatureSpec
from wardsift.operators.models import ModelConfig
from wardsift.operators.optimality import certify, objectives
from wardsift.operators.validation import cross_fit, group_training_set

CONFIGS = [ModelConfig(C=c, l1_ratio=r, class_weight=w) for c in (0.1, 10.0) for r in (0.0, 1.0) for w in (None, "balanced")]
SPEC = FeatureSpec(("a", "b", "copy"), ("kind",))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        a, b, kind = rng.randint(0, 4), rng.choice([0.1, 0.5, 2.0]), rng.choice("xyz")
        p = 1 / (1 + math.exp(-(0.8 * a - 2 * b + (kind == "y") - 0.5)))
        rows.append((i, a, b, 3.0 - 2.0 * a, kind, int(rng.random() < p)))
    table = spark.createDataFrame(rows, "case_id long, a int, b double, copy double, kind string, label int")
    return group_training_set(table, SPEC, "group_kfold", 3)


def test_every_fitted_model_is_certified(data):
    rows = certify(data, cross_fit(data, CONFIGS), CONFIGS).collect()
    assert len(rows) == len(CONFIGS) * 3 * 6 and all(r.optimal for r in rows)
    assert {r.feature for r in rows} == {"a", "b", "copy", "kind_y", "kind_z", "intercept"}
    # ``copy`` depends on ``a``, so L1 leaves their split open, but not their slopes.
    assert all(abs(a.slope + b.slope) < 1e-3 for a in rows for b in rows if a.feature == "a" and b.feature == "copy" and a[:2] == b[:2])


def test_other_coefficients_are_not_certified(data):
    fits = cross_fit(data, CONFIGS)
    best = {tuple(r[:2]): r.objective for r in objectives(data, fits, CONFIGS).collect()}
    moved = {k: dataclasses.replace(m, coefficients=(m.coefficients[0], m.coefficients[1] + 0.02, *m.coefficients[2:])) for k, m in fits.items()}
    rows = certify(data, moved, CONFIGS).collect()
    assert {(r.config_id, r.split_id) for r in rows if not r.optimal} == set(fits)
    worse = {tuple(r[:2]): r.objective for r in objectives(data, moved, CONFIGS).collect()}
    assert all(worse[k] > best[k] for k in best)
    silent = {k: dataclasses.replace(m, coefficients=(0.0,) * len(m.coefficients)) for k, m in fits.items()}
    assert not all(r.optimal for r in certify(data, silent, CONFIGS).where("config_id >= 4 AND coef = 0").collect())
