import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardsift.llm import op5_lm, packed
from wardsift.llm.frames import CLEANUP, written
from wardsift.llm.op5_lm import interpolated_scores


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


def brute(rows, passes=20):
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        if fold[i] == 0:
            continue
        ws = tokens(t)
        for k in (0, 1) if fold[i] != 9 else (1,):
            uni[k].update(ws + ["<s>"])
            bi[k].update(zip(["<s>"] + ws, ws))
    n = [sum(c for w, c in u.items() if w != "<s>") for u in uni]
    v = len(uni[1]) - 1
    bucket = lambda c: min(int(math.log2(c)) + 1, 31) if c else 0
    weights = {b: [0.2, 0.3, 0.5] for b in range(1, 32)} | {0: [0.4, 0.6, 0.0]}
    probs = lambda k, u, w: [1 / (v + 1), uni[k][w] / n[k], bi[k][u, w] / uni[k][u] if uni[k][u] else 0]
    cut = [(u, w) for i, t in rows if fold[i] == 9 for u, w in zip(["<s>"] + tokens(t), tokens(t))]
    for _ in range(passes):
        sums = {}
        for u, w in cut:
            b = bucket(uni[0][u])
            parts = [a * p for a, p in zip(weights[b], probs(0, u, w))]
            s = sums.setdefault(b, [0, 0, 0])
            for k in range(3):
                s[k] += parts[k] / sum(parts)
        before = dict(weights)
        for b, s in sums.items():
            weights[b] = [x / sum(s) for x in s]
        for b, a in weights.items():
            a = [max(a[0], 1e-6), a[1], a[2]]
            weights[b] = [x / sum(a) for x in a]
        if max(abs(x - y) for b in weights for x, y in zip(weights[b], before[b])) < 1e-4:
            break
    out = {}
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[1][w] + 0.1) / (n[1] + 0.1 * (v + 1))) for w in ws)
        score = sum(math.log10(sum(a * p for a, p in zip(weights[bucket(uni[1][u])], probs(1, u, w)))) for u, w in zip(["<s>"] + ws, ws))
        out[i] = (fold[i] == 0, len(ws), sum(uni[1][w] > 0 for w in ws), n[1], pytest.approx(base), pytest.approx(score))
    return out


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        vocab = [f"W{j}é" for j in range(rng.choice([5, 50, 400]))]
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))))
    rows += [(200, None), (201, ""), (202, "long " * 4000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fold string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in interpolated_scores(docs).collect()}
    assert got == brute(rows)
    assert 0 < sum(v[0] for v in got.values()) < 60


def test_held_out_texts_are_predicted_better_than_by_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = interpolated_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert interpolated_scores(spark.createDataFrame([], schema)).count() == 0
    got = interpolated_scores(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in got) == [(0, True, 3), (0, True, 3), (1, False, 1)]
    assert all(math.isfinite(r.score) for r in got)


def test_counts_beyond_32_bits_are_summed_whole():
    group, facts = np.array([0, 1, 0]), np.array([[3 * 10**9, 1], [2, 5 * 10**9], [3 * 10**9, 2**40]], np.uint64)
    assert op5_lm._sum_group(group, facts, group).tolist() == [[6 * 10**9, 2**40 + 1], [2, 5 * 10**9], [6 * 10**9, 2**40 + 1]]
    sent = packed.from_planes(packed.planes(facts.T)).reshape(2, -1).T
    assert (sent == facts).all()


@pytest.mark.parametrize("setting", [None, "false"])
def test_written_steps_leave_no_shuffle_files(spark, setting):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    spark.conf.unset(CLEANUP) if setting is None else spark.conf.set(CLEANUP, setting)
    try:
        before = shuffles()
        sums = written(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
        assert spark.conf.get(CLEANUP, None) == setting
        for _ in range(100):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        assert not shuffles() - before
        assert sums.agg(F.sum("s")).first()[0] == 4999 * 2500
    finally:
        spark.conf.unset(CLEANUP)
