"""Annotation path, sources, sinks, whole runs and plan shapes."""

import random
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from checks import views
from checks.compare import compare_frame
from wardsift.functions.signals import parse_list_text
from wardsift.operators.annotation import (
    annotate,
    build_requests,
    numbered_keys,
    normalize_responses,
    per_batch,
    per_text,
    probe_cache,
    request_body,
    split_quarantine,
    unpack_responses,
    value_rules,
    with_cache_key,
)
from wardsift.plans.escalate import escalate_by_annotator, escalate_by_rules, evaluate
from wardsift.plans.profile import profile_texts
from wardsift.schemas import REPORTS
from wardsift.sources import reports as R, tables as S
from wardsift.streaming.escalation_stream import escalate_stream, stream_reports

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


RESPONSES = {
    "full": '{"expected_action": false, "severity": "high", "risk_factors": ["a", "b"], "uncertainty_level": "low", "missing_information": [], "confidence": 0.4}',
    "empty": "{}",
    "nulls": '{"expected_action": null, "severity": null, "risk_factors": null, "confidence": null}',
    "texts": '{"expected_action": "False", "risk_factors": "a, b", "confidence": "0.5"}',
    "maybe": '{"expected_action": "maybe"}',
    "number": '{"confidence": "sure"}',
    "broken": '{"expected_action": tr',
    "none": None,
}


def test_normalize_responses(spark):
    df = spark.createDataFrame(list(RESPONSES.items()), "k string, raw_json string")
    good, bad = split_quarantine(normalize_responses(df))
    got = {r["k"]: r for r in good.collect()}
    assert {r["k"]: r["quarantine_reason"] for r in bad.collect()} == {
        "maybe": "bad_action", "number": "bad_confidence", "broken": "broken_json", "none": "no_response",
    }
    assert got["full"]["expected_action_llm"] is False and got["full"]["n_risk_factors"] == 2
    for key in ("empty", "nulls"):
        r = got[key]
        assert (r["expected_action_llm"], r["severity"], r["uncertainty_level"], r["confidence"]) == (True, "unknown", "unknown", 0.0)
        assert (r["n_risk_factors"], r["n_missing_information"], r["confidence_derived"]) == (0, 0, None)
    assert got["texts"]["expected_action_llm"] is False and got["texts"]["risk_factors"] == ["a", "b"]
    assert got["texts"]["confidence"] == 0.5 and got["full"]["confidence_derived"] == 0.85


def test_value_rules(spark):
    df = spark.createDataFrame(
        [("low", "low", 0.4, 1), ("odd", "high", 1.5, 1), ("low", None, 0.9, 0)],
        "severity string, uncertainty_level string, confidence double, n_missing_information int",
    )
    assert [r["violations"] for r in value_rules(df).collect()] == [
        [], ["severity", "confidence_range", "confidence_with_missing_information"], ["uncertainty_level"],
    ]


def _keyed(spark, n=23):
    data = [(i, f"text {i % 17} \"quoted\"\nline") for i in range(n)]
    return with_cache_key(spark.createDataFrame(data, "case_id long, report_text string"), "p", "n")


def test_probe_asks_for_each_missing_text_once(spark):
    keyed = _keyed(spark)
    cache = keyed.filter("case_id < 5").select("cache_key", F.lit("{}").alias("raw_json"))
    hits, misses = probe_cache(keyed, cache.unionByName(cache))
    assert hits.count() == 10 and misses.count() == 12
    assert misses.select("cache_key").distinct().count() == 12


def test_requests_and_responses(spark):
    _, misses = probe_cache(_keyed(spark), spark.createDataFrame([], "cache_key string, raw_json string"))
    requests = build_requests(misses).cache()
    assert sorted(len(r["cache_keys"]) for r in requests.collect()) == [2, 5, 5, 5]
    keys = [k for r in sorted(requests.collect(), key=lambda r: r["batch"]) for k in r["cache_keys"]]
    assert keys == sorted(keys)
    assert sum(len(r["cache_keys"]) for r in requests.collect()) == 17
    body = request_body(requests, "do it", "{}", "allowed").first()["request"]
    assert body.startswith("do it\nJSON schema:\n{}\nallowed\nReports:\n[{")
    sent = {r["cache_key"]: r["report_text"] for r in misses.collect()}
    responses = []
    for i, r in enumerate(requests.collect()):
        texts = json.loads(r["texts_json"])
        assert [t["text"] for t in texts] == [sent[k] for k in r["cache_keys"]]
        answer = json.dumps([{"severity": "low", "n": t["id"]} for t in texts[: len(texts) - (i == 0)]])
        responses.append((r["batch"], answer if i != 1 else answer[:-3]))
    schema = requests.select("batch").schema.add("raw_json", "string")
    unpacked = unpack_responses(requests, spark.createDataFrame(responses, schema))
    first, second = (len(r["cache_keys"]) for r in requests.collect()[:2])
    assert unpacked.count() == 17 and unpacked.filter("raw_json IS NULL").count() == 1 + second
    assert first >= 1


def test_requests_sort_no_texts_and_probes_hash_them_once(spark):
    keyed = _keyed(spark, 200)
    _, misses = probe_cache(keyed, keyed.filter("case_id < 5").select("cache_key", F.lit("{}").alias("raw_json")))
    plan = misses._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan and "_bits" in plan
    windows = build_requests(misses)._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1:]
    assert len(windows) == 2 and not any("report_text" in w.splitlines()[0] for w in windows)


def test_keys_are_numbered_in_order(spark):
    keys = sorted(f"{(i * 2654435761) % 2**32:08x}" for i in range(3000))
    got = numbered_keys(spark.createDataFrame([(k,) for k in keys], "cache_key string").repartition(7), digits=2).collect()
    assert sorted((r["number"], r["cache_key"]) for r in got) == list(enumerate(keys))


@pytest.mark.parametrize("bits", [64, 1 << 16, 1 << 27])
def test_key_filter_lets_every_key_through(spark, bits):
    from wardsift.operators.key_filter import key_filter, may_contain

    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "case_id")
    built = key_filter(keys.unionByName(spark.createDataFrame([(None,)], "case_id long")), "case_id", bits)
    assert built.count() <= bits // 32768 + 2
    passed = {r[0] for r in may_contain(spark.range(6000).withColumnRenamed("id", "case_id"), "case_id", built, bits).collect()}
    assert set(range(0, 3000, 3)) <= passed
    if bits == 1 << 27:
        assert len(passed) < 1010


def test_null_and_repeated_ids_keep_their_texts(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "a")]
    keyed = with_cache_key(spark.createDataFrame(rows, "case_id long, report_text string"), "p", "n")
    _, misses = probe_cache(keyed, spark.createDataFrame([], "cache_key string, raw_json string"))
    assert sorted(r["report_text"] for r in misses.collect()) == ["a", "b", "c"]


def test_annotators(spark):
    _, misses = probe_cache(_keyed(spark), spark.createDataFrame([], "cache_key string, raw_json string"))
    assert annotate(misses, per_text(lambda t: json.dumps({"n": len(t)}))).count() == 17
    short = annotate(misses.coalesce(1), per_batch(lambda ts: ["{}"] * (len(ts) - 1)))
    assert short.filter("raw_json IS NULL").count() == 4


def _answerer(on_call=None):
    """Annotator of one text, as a closure so that workers need no test module."""

    def answer(text):
        if on_call is not None:
            on_call(1)
        severity = "high" if "bleeding" in text else "low"
        return json.dumps({"expected_action": severity == "high", "severity": severity, "confidence": 0.9, "uncertainty_level": "low"})

    return answer


def _reports(spark, n=40):
    data = [
        (i, "psych" if i % 2 else "somatic", "clear", "escalation" if i % 4 == 0 else "no_escalation", f"case {i % 20} " + ("bleeding" if i % 4 == 0 else "calm"), None)
        for i in range(n)
    ]
    return spark.createDataFrame(data, REPORTS)


def test_escalation_run_pays_once_per_text(spark, tmp_path):
    cache, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)
    paid = _answerer(lambda n: calls.add(n))
    reports = _reports(spark)
    decided, quarantined = escalate_by_annotator(reports, per_text(paid), cache, "v6")
    assert decided.count() == 40 and quarantined.count() == 0 and calls.value == 20
    result = evaluate(decided, "expected_action_final", by=("domain",))
    assert {r["domain"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in result.metrics.collect()} == {
        "psych": (20, 0, 0, 0), "somatic": (10, 0, 0, 10),
    }
    assert result.errors.count() == 0 and result.report.count() == 10
    escalate_by_annotator(reports, per_text(paid), cache, "v6")
    assert calls.value == 20 and S.read_cache(spark, cache).count() == 20


def test_rules_run(spark):
    matched = escalate_by_rules(_reports(spark), {"b": ["bleeding"]})
    m = evaluate(matched, "expected_action_rule").metrics.first()
    assert (m["precision"], m["recall"]) == (1.0, 1.0)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    paths = {n: str(tmp_path / n) for n in ("cache", "checkpoint")}

    def run():
        query = escalate_stream(stream_reports(spark, source), per_text(_answerer()), paths["cache"], out, paths["checkpoint"])
        query.awaitTermination()

    reports = _reports(spark)
    reports.filter("case_id < 25").write.parquet(source)
    run()
    assert spark.read.parquet(f"{out}/decided").count() == 25
    reports.filter("case_id >= 25").write.mode("append").parquet(source)
    run()
    done = spark.read.parquet(f"{out}/decided")
    assert done.count() == 40 and done.select("case_id").distinct().count() == 40
    assert S.read_cache(spark, paths["cache"]).count() == 20


def test_profile_plan(spark):
    reports = views.docs(spark, SF).join(views.truth(spark, SF), "case_id", "left")
    profile = profile_texts(reports)
    assert profile.metrics.count() == 200 and profile.describe_overall.count() == 9
    assert "report_text" not in profile.metrics.columns and profile.extremes.count() == 1


def test_read_reports(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('case_id,domain,clarity,expected_action,report_text,comment\n1,psych,clear,escalation,"two\nlines, ""quoted""",\n')
    df = R.read_reports(spark, "v2", {"v2": str(path)})
    assert df.schema == REPORTS and df.first()["report_text"] == 'two\nlines, "quoted"'
    with pytest.raises(ValueError, match="unknown dataset"):
        R.read_reports(spark, "v3", {"v2": str(path)})


def test_read_runs(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"k,{name}\n1,x\n")
    runs = R.read_runs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert len(runs) == 2 and rows(R.union_runs(runs).select("k", "a", "b")) == [("1", "x", None), ("1", None, "x")]
    with pytest.raises(ValueError):
        R.union_runs({})


@pytest.mark.parametrize("delimiter", ["\t", ";", ","])
def test_dialects(spark, tmp_path, delimiter):
    path = tmp_path / "d.csv"
    amount = "1,5" if delimiter != "," else '"1,5"'
    path.write_bytes(delimiter.join(["id", "Straße", "amount"]).encode("latin-1") + b"\n" + delimiter.join(["1", "é", amount]).encode("latin-1") + b"\n")
    df = R.read_csv_dialect(spark, str(path), ["amount"])
    assert df.columns == ["id", "Straße", "amount"] and tuple(df.first()) == ("1", "é", 1.5)


def test_delimiter_priority_and_failure():
    assert R.delimiter_of("a;b,c\td") == "\t" and R.delimiter_of("a;b,c") == ";"
    with pytest.raises(ValueError):
        R.delimiter_of("single")


def test_single_column(spark):
    df = spark.createDataFrame([("1,2,3,4",), ("5",)], ["accident_id, b ,c"])
    assert R.fix_single_column(df).columns == ["Num_Acc", "b", "c"]
    assert rows(R.fix_single_column(df)) == [("1", "2", "3"), ("5", None, None)]
    plain = spark.createDataFrame([("x",)], ["name"])
    assert R.fix_single_column(plain).columns == ["name"]
    tabs = spark.createDataFrame([("1\t2",)], ["a\tb"])
    assert rows(R.fix_single_column(tabs)) == [("1", "2")]


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Accident_Id;v\n1;2,5\n")
    (tmp_path / "b.csv").write_text("Accident_Id;v\n2;3,5\n")
    (tmp_path / "c.csv").write_text("accident_id\tw\n3\tx\n")
    df = R.read_folder(spark, str(tmp_path), ["v"])
    assert rows(df.select("Num_Acc", "v", "w")) == [("1", 2.5, None), ("2", 3.5, None), ("3", None, "x")]


def test_read_prepared(spark, tmp_path):
    (tmp_path / "p.csv").write_text("case_id,confidence,n_risk_factors,n_missing_information,expected_action,risk_factors\n1,0.5,2,x,escalation,[]\n")
    r = R.read_prepared(spark, str(tmp_path / "p.csv")).first()
    assert (r["confidence"], r["n_risk_factors"], r["n_missing_information"], r["label"]) == (0.5, 2.0, None, 1)
    with pytest.raises(ValueError):
        R.read_prepared(spark, str(tmp_path / "p.csv"), strict=True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b")], "z int, a string")
    path = str(tmp_path / "t")
    S.write_result(df, path, run_id="r1", mode="append")
    S.write_result(df, path, run_id="r2", mode="append")
    assert rows(spark.read.parquet(path).select("run_id", "z")) == [("r1", 1), ("r2", 1)]
    with pytest.raises(Exception, match="already exists"):
        S.write_result(df, path)
    S.write_once(df.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    S.write_json(df, str(tmp_path / "j"))
    S.append_json(df, str(tmp_path / "j"))
    assert S.read_json(spark, str(tmp_path / "j"), df.schema).count() == 2
    assert S.read_cache(spark, str(tmp_path / "nothing")).count() == 0


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run, ts in (("a", datetime(2024, 1, 1, 9)), ("b", datetime(2024, 1, 1, 10))):
        S.append_ledger(S.ledger_rows(spark, "e", run, ts, {"metric": {"f2": 0.5, "none": None}, "tag": {"run": run}}), path)
    ledger = S.read_ledger(spark, path)
    assert S.latest_runs(ledger).first()["run_id"] == "b"
    assert rows(S.restore_latest(ledger).select("kind", "key", "value")) == [
        ("metric", "f2", "0.5"), ("metric", "none", None), ("tag", "run", "b"),
    ]


def test_runtime_metrics(spark, tmp_path):
    df, seen = S.timed(spark.range(50))
    df.write.parquet(str(tmp_path / "o"))
    assert S.runtime_metrics(seen, 5.0) == {"run_time_total": 5.0, "n_rows": 50, "run_time_per_sample": 0.1}


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["domain", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "f2"] and df.count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


PYTHON_ALLOWED = {"annotate_misses", "annotate_misses_batch"}


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    """Right rows from a plan that stays in the JVM and has no nested-loop join."""
    df = __spark_entry__.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan or (node == "MapInPandas" and name in PYTHON_ALLOWED), node
    ok, note = compare_frame(df, SF, name)
    assert ok, note


def test_dialect_reader_gives_the_same_rows_for_any_projection(spark, tmp_path):
    from wardsift.sources.reports import read_csv_dialect

    (tmp_path / "a.csv").write_text('id;a;b\n1;x;2,5\n2;y\n3;x;1;surplus\n4;"q;""r";7\n5;x;1;\n6;;\n', encoding="latin-1")
    (tmp_path / "b.csv").write_text("id;a;b\n7;\xe9;1\n", encoding="latin-1")
    table = read_csv_dialect(spark, str(tmp_path), ["b"])
    want = [("1", "x", 2.5), ("2", "y", None), ("4", 'q;"r', 7.0), ("6", None, None), ("7", "\xe9", 1.0)]
    assert sorted(tuple(r) for r in table.collect()) == want
    assert table.count() == 5
    assert sorted(r[0] for r in table.select("id").collect()) == ["1", "2", "4", "6", "7"]
    assert table.select("a").count() == 5 and table.where("b is null").count() == 2


def test_list_literals_with_constants(spark):
    texts = ["['a' , None]", "[True, 'None, x', False]", "[None", "['it\\'s None', None]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_list_text("t").alias("l")).collect()
    assert [r.l for r in rows] == [["a", None], ["True", "None, x", "False"], [], ["it's None", None]]


def _bytes_read(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def test_headers_are_read_without_the_files(spark, tmp_path):
    from wardsift.sources.headers import _by_text_reader, first_line

    names = ["a b.csv", "c%20d.csv", "e.csv", "empty.csv", "one line.csv"]
    texts = ["x;ä\n1;2\n", "x;y\r\n1;2\r\n", "x;z\r3;4\r", "", "only;header"]
    for name, text in zip(names, texts):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    got = R.header_lines(spark, str(tmp_path))
    assert {p.rsplit("/", 1)[1]: h for p, h in got.items()} == dict(zip([n for n in names if n != "empty.csv"], ["x;ä", "x;y", "x;z", "only;header"]))
    spark_way = _by_text_reader(spark, [(tmp_path / n).as_uri() for n in (names[0], names[2])])
    assert sorted(bytes(r.line).decode("latin-1") for r in spark_way.collect()) == ["x;z", "x;ä"]
    with open(tmp_path / "huge", "wb") as f:  # a sparse file of a terabyte
        f.write(b"q;r\n")
        f.truncate(1 << 40)
    assert first_line((tmp_path / "huge").as_uri()) == b"q;r"


def test_a_folder_is_read_once(spark, tmp_path):
    line = "1;" + "x" * 200
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("Accident_Id;v\n" + (line + "\n") * 5000)
    before = _bytes_read(spark)
    assert R.read_folder(spark, str(tmp_path)).count() == 15_000
    size = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert size <= _bytes_read(spark) - before < 1.2 * size


def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import types as T

    from wardsift.sources.quoted import _open_parts, _parts, read_quoted_csv

    rng = random.Random(9)
    rows = []
    for i in range(900):
        parts = [rng.choice(["plain", "a, b", 'say ""yes""', "line\nbreak", "\n\n", '""', "x" * 90]) for _ in range(rng.randint(1, 6))]
        rows.append(f'{i},"{" ".join(parts)}",{"" if i % 7 == 0 else "tail"}')
    rows[400] = '400,"' + "long\n" * 9000 + '",tail'  # one record over many parts
    (tmp_path / "a.csv").write_text("id,body,more\n" + "\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text('id,body,more\n7000,"first\nrecord",z\n\n7001,"open at the end\nof the file')
    schema = T.StructType([T.StructField("more", T.StringType()), T.StructField("id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("none", T.StringType())])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = _parts(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        states = _open_parts(lines).collect()
        assert {r["open"] for r in states} == {True, False}
        got = sorted(tuple(r) for r in read_quoted_csv(spark, str(tmp_path), schema).select("id", "body", "more", "none").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plain = spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True, escape='"', schema="id long, body string, more string")
    want = sorted((*r, None) for r in plain.collect())
    assert [r for r in got if r[0] < 7000] == want and len(want) == 900
    assert [r for r in got if r[0] >= 7000] == [(7000, "first\nrecord", "z", None), (7001, "open at the end\nof the file", None, None)]
