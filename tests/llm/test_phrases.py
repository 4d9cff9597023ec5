import random
import re
from collections import Counter

import numpy as np
import pytest

from checks.compare import compare
from wardsift.llm import op11_phrases
from wardsift.llm.op11_phrases import RESULT, collocations
from wardsift.llm.quotient_filter import Filter, count, decode, encode, merge, permute, restore, slices

COLUMNS = "lang string, text string, phrase string, n int"


def brute(rows, least=10, top=2000):
    f, n = {}, Counter()
    for lang, text, *_ in rows:
        own = f.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(ws)
            own.update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for g, a in own.items():
            if len(g) < 2 or a < least:
                continue
            if len(g) == 2 and any(100 * b >= 50 * a for h, b in own.items() if len(h) == 3 and b >= least and g in (h[:2], h[1:])):
                continue
            score, _, l, r = min((10**6 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("bits", [1, 5, 21, 22, 32])
def test_filters_count_without_loss(bits):
    rng = np.random.default_rng(bits)
    grams = rng.integers(0, 1 << bits, (3, 5000)) % min(1 << bits, 40)
    high, low = permute(grams, bits)
    assert (restore(high, low, bits) == grams).all()
    counts = rng.integers(1, 2**40, 5000).astype(np.uint64)
    whole = count(high, low, counts, bits)
    want = Counter()
    for g, c in zip(grams.T.tolist(), counts.tolist()):
        want[tuple(g)] += c
    for prefix_bits in {0, min(bits, 3), bits}:
        parts = [decode(e, p, bits, prefix_bits) for p, e in slices(whole, bits, prefix_bits)]
        again = Filter(*map(np.concatenate, zip(*parts)))
        assert all((a == b).all() for a, b in zip(again, whole))
    twice = merge([whole, whole, count(high[:10], low[:10], counts[:10], bits)], bits)
    got = dict(zip(map(tuple, restore(twice.high, twice.low, bits).T.tolist()), twice.count.tolist()))
    for g, c in zip(grams.T[:10].tolist(), counts[:10].tolist()):
        got[tuple(g)] -= c
    assert got == {g: 2 * c for g, c in want.items()}
    none = count(high[:0], low[:0], counts[:0], bits)
    assert len(decode(encode(none, bits, 0), 0, bits, 0).high) == 0


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(11)] + ["Éa", "ÉA", "new", "York", "city#"]
    rows = []
    for i in range(160):
        ws = rng.choices(vocab, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 4)):
            ws[5:5] = ["New", "york", "City"] if rng.random() < 0.7 else ["new", "York"]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", " ! "]) for w in ws)
        rows.append((rng.choice(["en", "en", "en", "de", None]), text, "clash", i))
    return rows + [("en", None, "", 0), ("fr", "", "", 0), ("fr", " . , ", "", 0), ("de", "z " * 30_000, "", 0)] + rows[:3] * 4


def test_rows_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = collocations(docs)
    assert got.columns == [c.split()[0] for c in RESULT.split(", ")]
    want = brute(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 60
    assert {r[0] for r in want} == {"en", "de", "und"}
    # Many small filters, prefixes and levels.
    monkeypatch.setattr(op11_phrases, "SLICE_BYTES", 1 << 11)
    monkeypatch.setattr(op11_phrases, "ENTRIES", 1)
    monkeypatch.setattr(op11_phrases, "PART_BYTES", 1 << 12)
    monkeypatch.setattr(op11_phrases, "FAN", 2)
    monkeypatch.setattr(op11_phrases, "FAN_BITS", 2)
    assert sorted(tuple(r) for r in collocations(docs, top=7).collect()) == brute(rows, top=7)


def test_large_counts_and_empty_table(spark):
    assert collocations(spark.createDataFrame([], COLUMNS)).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b", "", 0)], COLUMNS)).count() == 0
    big = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12)], "a long, l long, r long")
    assert big.select(op11_phrases._score("a", "l", "r")).first()[0] == 10**6 * 9 * 10**24 // (20 * 10**24)


def test_query_equals_sql_over_whole_table(spark):
    import wardsift.llm.queries  # noqa: F401

    assert compare(spark, "/root/testdata/sf0.001", "op11_phrases")[0]
