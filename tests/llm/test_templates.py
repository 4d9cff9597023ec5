import random
import re

import pytest
from checks.compare import compare

from wardsift.llm.op1_decontamination import contaminated, drop_contaminated
from wardsift.llm.op3_licenses import NOTICES, license_matches


def grams(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(ws[i : i + width]) for i in range(max(len(ws) - width + 1, min(len(ws), 1)))}


def tables():
    rng = random.Random(8)
    vocab = [f"W{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 9, 40, 200, 900])))) for i in range(80)] + [(80, None), (81, ""), (81, "one two")]
    docs = [(1000, None, 1), (1001, "", 2), (1002, "ONE two", 3)]
    for i in range(200):
        ws = rng.choices(vocab, k=rng.choice([0, 20, 300, 6000]))
        for _, t in rng.choices(items[:80], k=rng.randint(0, 2)):
            part = t.lower().split()
            if rng.random() < 0.4:
                part = part[: max(1, int(len(part) * rng.uniform(0.7, 1)))]
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, "".join(w + rng.choice(" \n\t") for w in ws), i))
    return docs, items


def test_matches_equal_exact_containment(spark):
    docs, items = tables()
    want = set()
    for d, t, _ in docs:
        own = grams(t)
        for i, u in items:
            g = grams(u)
            if g and len(g & own) >= 0.8 * len(g):
                want.add((d, i, len(g), len(g & own)))
    left = spark.createDataFrame(docs, "doc_id long, text string, item_id long").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in contaminated(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clean = drop_contaminated(left, right)
    assert clean.columns == left.columns
    hit = {w[0] for w in want}
    assert {r.doc_id for r in clean.collect()} == {d for d, _, _ in docs} - hit and len(hit) > 30


def test_blocks_of_items_give_the_same_matches(spark, monkeypatch):
    import wardsift.llm.templates as templates

    docs, items = tables()
    left, right = spark.createDataFrame(docs[:80], "doc_id long, text string, x long"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in contaminated(left, right).collect()}
    monkeypatch.setattr(templates, "BLOCK_SHINGLES", 2000)
    assert {tuple(r) for r in contaminated(left, right).collect()} == whole
    assert drop_contaminated(left, right).count() == 80 - len({w[0] for w in whole})


def test_licenses_are_found_in_long_texts(spark):
    rng = random.Random(2)
    docs = [(0, None)]
    for k, notice in enumerate(NOTICES.values()):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
        at = rng.randrange(5000)
        docs.append((k + 1, " ".join(ws[:at] + notice.upper().split() + ws[at:])))
    got = {(r.doc_id, r.license_id): r for r in license_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, name in enumerate(NOTICES):
        row = got.pop((k + 1, name))
        words = docs[k + 1][1].split()
        assert row.n_shared == row.n_template and words[row.first_word].lower() == NOTICES[name].split()[0].lower()
    assert all(a.startswith(("apache", "mit")) for _, a in got)


@pytest.mark.parametrize("run", [lambda d, s: contaminated(d, s.createDataFrame([(1, "a b c d e f")], "item_id long, text string")), lambda d, s: license_matches(d)])
def test_empty_tables_and_null_ids(spark, run):
    schema = "doc_id long, text string, license_id string, item_id string"
    assert run(spark.createDataFrame([], schema), spark).count() == 0
    text = "a b c d e f Released under the MIT License."
    rows = run(spark.createDataFrame([(None, text, "x", "y"), (2, text, None, None), (2, text, None, None)], schema), spark).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [None, 2, 2]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), empty).count() == 0


@pytest.mark.parametrize("name", ["op1_decontamination", "op3_licenses", "op7_warc"])
def test_queries_equal_sql_over_whole_tables(spark, name):
    import wardsift.llm.queries  # noqa: F401

    assert compare(spark, "/root/testdata/sf0.001", name)[0]
