"""Column expressions on hand-made rows."""

import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from wardsift.functions.hashing import feature_signature, hash_draw
from wardsift.functions.labels import encode_label, encode_prediction, error_type, label_text, lenient_double
from wardsift.functions.rules import DECISION_RULES, Signals, decision, dictionary_hits, keywords_found
from wardsift.functions.signals import cache_key, confidence_derived, list_size, parse_list_text
from wardsift.functions.text import text_hash, text_metrics, tokens, vocabulary_count
from wardsift.operators.profile import with_text_metrics

TEXTS = [
    None,
    "",
    "one",
    "a bb ccc",
    "Über ÄÖÜ straße naïve.",
    "١٢٣ and 42!? ... end",
    "combining é mark",
    "non breaking space, tab\tand\nline",
    "x_y 9abc abc9 don't co-op",
    "😀 emoji 文字 text.",
]


def test_text_metrics_match_unicode_definitions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in text_metrics("t").items()]).collect()}
    for i, text in enumerate(TEXTS):
        t = text or ""
        want = (
            len(t),
            len(re.findall(r"\b\w+\b", t)),
            len(re.findall(r"[.!?]+", t)),
            len(re.findall(r"\d", t)),
            len(re.findall(r"[A-ZÄÖÜ]", t)),
            len(re.findall(r"[^\w\s]", t)),
        )
        assert tuple(got[i][1:]) == want, text


def test_ratios_are_zero_without_characters(spark):
    df = spark.createDataFrame([(None,), ("",), ("A1.",)], "report_text string")
    rows = with_text_metrics(df).select("digit_ratio", "upper_ratio", "punct_ratio").collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1 / 3, 1 / 3, 1 / 3)]


def test_text_metrics_subset_and_unknown(spark):
    df = spark.createDataFrame([("ab cd",)], "report_text string")
    assert with_text_metrics(df, metrics=["n_words"]).columns == ["report_text", "n_words"]
    with pytest.raises(ValueError):
        with_text_metrics(df, metrics=["n_lines"])


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    for row in df.select("id", tokens("t").alias("k")).collect():
        assert row["k"] == re.findall(r"\b[a-zA-Z]{2,}\b", (TEXTS[row["id"]] or "").lower())


def test_vocabulary_count(spark):
    df = spark.createDataFrame([(["no", "yes", "no", "not"],), ([],)], "k array<string>")
    assert [r[0] for r in df.select(vocabulary_count("k", ["no", "not"])).collect()] == [3, 0]


def test_text_hash_ignores_case_and_outer_space(spark):
    df = spark.createDataFrame([("  Ab c\n",), ("ab C",)], "t string")
    hashes = {r[0] for r in df.select(text_hash("t")).collect()}
    assert hashes == {hashlib.sha256(b"ab c").hexdigest()}


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("  ", []),
        ("['a', 'b']", ["a", "b"]),
        ('["a", "b\'s"]', ["a", "b's"]),
        (r"['it\'s']", ["it's"]),
        ("['a', 'b',]", ["a", "b"]),
        ("[]", []),
        ("[", []),
        ("[a b]", []),
        ("a, b", ["a", "b"]),
        ("a,,b ", ["a", "b"]),
        ("single", []),
    ],
)
def test_parse_list_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(parse_list_text("t").alias("l"))
    row = df.select("l", list_size("l").alias("n")).first()
    assert row["l"] == want and row["n"] == len(want)


def test_list_size_of_null_is_zero(spark):
    assert spark.range(1).select(list_size(F.lit(None).cast("array<string>"))).first()[0] == 0


def test_confidence_derived(spark):
    df = spark.createDataFrame([("low",), ("medium",), ("high",), ("other",), (None,)], "u string")
    assert [r[0] for r in df.select(confidence_derived("u")).collect()] == [0.85, 0.6, 0.3, None, None]


def test_cache_key(spark):
    df = spark.createDataFrame([("Grüße",)], "t string")
    assert df.select(cache_key("t", "p", "ns")).first()[0] == hashlib.sha256("pGrüßens".encode()).hexdigest()
    assert df.select(cache_key("t", "p", "ns", "m")).first()[0] == hashlib.sha256("pGrüßensm".encode()).hexdigest()


def test_labels(spark):
    df = spark.createDataFrame([("escalation", True), ("no_escalation", False)], "y string, p boolean")
    row = [tuple(r) for r in df.select(encode_label("y"), encode_prediction("p"), label_text("p")).collect()]
    assert row == [(1, 1, "escalation"), (0, 0, "no_escalation")]
    for bad, expr in ((("maybe", True), encode_label("y")), ((None, True), encode_label("y")), (("escalation", None), encode_prediction("p"))):
        with pytest.raises(Exception, match="unknown label|invalid prediction"):
            spark.createDataFrame([bad], "y string, p boolean").select(expr).collect()


def test_error_type(spark):
    rows = list(itertools.product(["escalation", "no_escalation"], [True, False, None]))
    df = spark.createDataFrame(rows, "y string, p boolean").select(error_type("y", "p"))
    assert [r[0] for r in df.collect()] == [None, "false_negative", None, "false_positive", None, None]


def test_lenient_double(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), (" 2 ",)], "t string")
    assert [r[0] for r in df.select(lenient_double("t")).collect()] == [1.5, None, None, 2.0]


def test_keywords(spark):
    text = "Herzinsuffizienz, keine akute Blutung; hypotone Lage. ÖDEM"
    df = spark.createDataFrame([(text,), ("nichts",), (None,)], "t string")
    words = ["ödem", "hypoton", "blutung", "akute blutung"]
    assert [r[0] for r in df.select(keywords_found("t", words)).collect()] == [["ödem", "blutung", "akute blutung"], [], []]
    assert [r[0] for r in df.select(keywords_found("t", ["hypoton", "herz", "insuffizienz"], "prefix")).collect()] == [
        ["hypoton", "herz"],
        [],
        [],
    ]
    with pytest.raises(ValueError):
        keywords_found("t", ["a"], "suffix")


def test_dictionary_hits_keep_every_category(spark):
    df = spark.createDataFrame([(["a", "b"],)], "f array<string>")
    hits = df.select(dictionary_hits("f", {"x": ["a"], "y": ["a", "b"], "z": ["c"]})).first()[0]
    assert [tuple(h) for h in hits] == [("x", "a"), ("y", "a"), ("y", "b")]


def _decide(version, a, sev, unc, conf, rf, mi):
    """The rule table, spelled out case by case."""
    if a is None:
        return None
    conf = float("nan") if conf is None else conf
    supported = conf >= 0.8 or mi >= 2 or rf >= 2
    if version in ("v2", "v3"):
        return False if a and sev == "low" and conf < 0.4 and unc == "high" else a
    if version in ("v4", "v5", "v6"):
        if a:
            bare = sev == "medium" and rf == 0 and mi == 0
            extra = {"v4": False, "v5": bare and unc == "low", "v6": bare and conf >= 0.7}[version]
            return not (sev == "low" or extra)
        return sev == "high" or (sev == "medium" and supported)
    return a


@pytest.mark.parametrize("version", list(DECISION_RULES))
def test_every_cell_of_the_rule_table(spark, version):
    cells = list(
        itertools.product(
            [True, False, None],
            ["low", "medium", "high", "unknown", None],
            ["low", "medium", "high"],
            [0.39, 0.4, 0.69, 0.7, 0.79, 0.8, None],
            [0, 1, 2],
            [0, 1, 2],
        )
    )
    schema = "a boolean, severity string, uncertainty_level string, confidence double, n_risk_factors int, n_missing_information int"
    df = spark.createDataFrame(cells, schema).coalesce(1)
    got = [r[0] for r in df.select(decision(version, "a", Signals.named())).collect()]
    assert got == [_decide(version, *c) for c in cells]


def test_unknown_rule_version():
    with pytest.raises(ValueError):
        decision("v9", "a", None)


def test_signature_and_draw(spark):
    df = spark.createDataFrame([(0.5, None, "x"), (None, 3, None)], "d double, i int, s string")
    types = {f.name: f.dataType for f in df.schema}
    assert [r[0] for r in df.select(feature_signature(types)).collect()] == ["0.500000|nan|x", "nan|3|nan"]
    draw = spark.range(1).select(hash_draw("s", 42, 3, F.lit("k"))).first()[0]
    assert draw == hashlib.md5(b"s|42|3|k").hexdigest()
