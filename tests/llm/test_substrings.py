import hashlib
import random
import re

import numpy as np
import pytest
from checks.compare import compare
from pyspark.sql import functions as F

from wardsift.llm.op6_substrings import substring_dedup, substring_digests, without_repeats
from wardsift.llm.recompression import recompress


def brute(rows, width=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            if w in seen:
                gone |= set(range(s, s + width))
            seen.add(w)
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a " * 300, "a b " * 150, "x"]
    passages = [[f"p{k}_{j}" for j in range(rng.randint(18, 90))] for k in range(6)]
    for _ in range(120):
        vocab = [f"é{j}" for j in range(rng.choice([3, 30, 2000]))]
        ws = rng.choices(vocab, k=rng.randint(0, 150))
        for p in rng.choices(passages, k=rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = p[rng.randint(0, 5) :]
        texts.append("".join(w + rng.choice([" ", "\n", "\t "]) for w in ws))
    texts += rng.choices(texts, k=15)
    rows = [(i * 2 - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, chunk string").repartition(6)
    want = brute(rows)
    assert sorted(tuple(r) for r in substring_dedup(docs).collect()) == want
    digests = sorted(tuple(r) for r in substring_digests(docs).collect())
    assert digests == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in want]
    assert sum(r[2] for r in want) > 1000


def test_other_columns_and_untouched_texts_stay(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("b", text + " end", 2, 1.5), ("a", "\t" + text, 1, None), ("c", None, None, 2.5), ("d", "x\n y", 3, 0.0)]
    docs = spark.createDataFrame(rows, "id string, text string, doc_id long, was_null double")
    got = without_repeats(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("b", "end", 2, 1.5), *rows[1:]], key=str)


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(25)))
    got = substring_dedup(spark.createDataFrame([(None, text), (7, text), (7, text)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 25), (7, 0), (7, 25)]


def test_symbols_inside_equal_words_are_equal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        same = rng.integers(0, rng.choice([2, 5, 1000]), 40).astype(np.uint64)
        found = []
        for _ in range(2):
            left, right = (rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
            words, at = np.concatenate([left, same, right]), len(left)
            found.append([
                {(a - at, b - at, n) for a, b, n, lo, hi in zip(s.start, s.end, s.name, s.need_start, s.need_end) if lo >= at and hi <= at + 40}
                for s in recompress(words, np.zeros(len(words), np.int64), 3)
            ])
        assert found[0] == found[1]


def test_query_equals_sql_over_whole_table(spark):
    import wardsift.llm.queries  # noqa: F401

    assert compare(spark, "/root/testdata/sf0.001", "op6_substrings")[0]
