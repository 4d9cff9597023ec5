"""Numbers of the test tables that were measured independently (in SQL) before the build."""

import pytest
from pyspark.sql import functions as F

from checks import views
from wardsift.functions.labels import encode_label, encode_prediction
from wardsift.operators.decisions import decide, match_rules
from wardsift.operators.evaluation import confusion

SF = "/root/testdata/sf0.001"


def cells(df, pred):
    return tuple(confusion(df.select(encode_label("expected_action").alias("label"), encode_prediction(pred).alias("prediction"))).first())


@pytest.fixture(scope="module")
def labelled(spark):
    return views.labelled_signals(spark, SF).cache()


def test_severity(spark):
    counts = {r["severity"]: r["count"] for r in views.signals(spark, SF).groupBy("severity").count().collect()}
    assert counts == {"low": 157, "medium": 36, "high": 7}


def test_missing_information(spark):
    counts = views.signals(spark, SF).groupBy("n_missing_information").count().orderBy("n_missing_information").collect()
    assert [r["count"] for r in counts] == [9, 105, 78, 8]


def test_decisions(labelled):
    assert cells(labelled, "expected_action_llm") == (25, 51, 2, 9)
    assert cells(decide(labelled, "v6"), "expected_action_final") == (59, 17, 4, 7)


def test_rules(spark):
    matched = match_rules(views.docs(spark, SF), views.LEXICON).join(views.truth(spark, SF), "case_id")
    assert cells(matched, "expected_action_rule") == (76, 0, 4, 7)


def test_changes_by_v6(spark):
    decided = decide(views.signals(spark, SF), "v6")
    changes = decided.filter(F.col("expected_action_llm") != F.col("expected_action_final")).groupBy("expected_action_llm").count().collect()
    assert {r[0]: r[1] for r in changes} == {True: 80, False: 1}
