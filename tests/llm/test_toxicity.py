import math
import random
import re
import statistics
import zlib
from collections import defaultdict

import numpy as np

from wardsift.llm.op12_toxicity import LEAST_RATIO, MORE_WORDS, _equal_mass, _logistic, toxicity

COLUMNS = "doc_id long, text string, lang string, label int, score string"


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def expressions(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    pad = ["<", "<", *ws]
    return [((w,), (pad[i + 1], w), pad[i + 1], pad[i]) for i, w in enumerate(ws)]


def brute(rows, labels, discount=3.0, margin=1.0):
    contexts = {1: [defaultdict(set), defaultdict(set)], 2: [defaultdict(set), defaultdict(set)]}
    for i, text in rows:
        if labels.get(i) in (0, 1) and fold(i) > 1:
            for one, two, v, u in expressions(text):
                contexts[1][labels[i]][one].add(v)
                contexts[2][labels[i]][two].add(u)
    ratio = {}
    for of in contexts.values():
        n = [{e: len(s) for e, s in c.items()} for c in of]
        total = [sum(c.values()) for c in n]
        mass = sum(min(x, discount) for x in n[1].values()) / total[1]
        low, high = 0.0, max(n[0].values())
        for _ in range(200):
            other = (low + high) / 2
            low, high = (other, high) if sum(min(x, other) for x in n[0].values()) < mass * total[0] else (low, other)
        for e in set(n[0]) | set(n[1]):
            a, b = n[0].get(e, 0), n[1].get(e, 0)
            if a > other + 1e-9 or b > discount:
                shared = mass * (a + b) / sum(total)
                ratio[e] = math.log((max(b - discount, 0) / total[1] + shared) / (max(a - other, 0) / total[0] + shared))
    out = []
    for i, text in rows:
        found = [ratio.get(two, ratio.get(one, 0.0)) for one, two, _, _ in expressions(text)]
        middle = statistics.median(found) if found else 0.0
        out.append(math.log(sum(max(r - middle - margin, 0) for r in found) / (len(found) + MORE_WORDS) + LEAST_RATIO))
    own = [(x, labels[i]) for (i, _), x in zip(rows, out) if labels.get(i) in (0, 1) and fold(i) == 1]
    at, by = _logistic(np.array([x for x, _ in own]), np.array([y for _, y in own]))
    return [1 / (1 + math.exp(-(at + by * x))) for x in out]


def corpus(n=500):
    rng = random.Random(4)
    vocab, bad = [f"w{i}" for i in range(150)], ["Trash", "moron", "scum"]
    rows, labels = [], {}
    for i in range(n):
        ws = rng.choices(vocab, k=rng.randint(5, 150))
        labels[i] = int(rng.random() < 0.25)
        if labels[i]:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
            ws.insert(3, "shut")
            ws.insert(4, "up")
        rows.append((i, " ".join(ws)))
    return rows, labels


def test_scores_equal_brute_force(spark):
    rows, labels = corpus()
    labels |= {i: None for i in range(10, 40)} | {41: 7}
    rows += [(900, None), (901, ""), (902, "  "), (903, "trash " * 5000), (904, "plain " * 5000), (None, "moron"), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], COLUMNS).repartition(4)
    table = spark.createDataFrame([(i, y, 0) for i, y in labels.items()] + [(None, 1, 0)], "doc_id long, toxic int, text int")
    got = toxicity(docs, table)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.held_out, r.score, r.predicted) for r in got.collect())
    want = sorted(((-1 if i is None else i), fold(i) == 0, s) for (i, _), s in zip(rows, brute(rows, labels)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)
    assert all(g[3] == int(g[2] >= 0.5) for g in got)
    held = [(g[3], labels[g[0]]) for g in got if g[1] and labels.get(g[0]) in (0, 1)]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], COLUMNS)
    other = spark.createDataFrame([(i, t, "de", 0, "y") for i, t in rows], COLUMNS)

    def scores(d, lab):
        return sorted(tuple(r) for r in toxicity(d, spark.createDataFrame(list(lab.items()), "doc_id long, toxic int")).collect())

    first = scores(docs, labels)
    assert scores(other, {i: 1 - y if fold(i) == 0 else y for i, y in labels.items()}) == first


def test_no_labels_one_class_limits_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"a b w{i}", "en", 1, "x") for i in range(20)], COLUMNS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.5}
    clean = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity(docs, clean).collect())
    assert toxicity(docs.limit(0), clean).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity(docs, both, max_labelled=3).count() == 20
    assert {r.score for r in toxicity(docs, both, max_words=1).collect()} == {0.5}


def test_discounts_leave_equal_mass():
    values, times = np.array([1, 9, 3]), np.array([50, 2, 10])
    for mass in (0.3, 0.7, 0.95, 1.0):
        d = _equal_mass(values, times, mass)
        assert abs(np.minimum(values, d) @ times - mass * (values @ times)) < 1e-9
