import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardsift.llm.op2_simhash import anchors, simhash_groups


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if bin(f ^ g).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in prints}


def test_fingerprints_and_groups_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["é", "Alpha", "beta", "Gamma", "x" * 40, "ß", "delta"] + [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 400))) for _ in range(40)]
    texts = base + [t.upper() for t in base[:5]] + [re.sub(r"w1\b", "w2", t) for t in base] + [None, "", " \t", "one", "one two"]
    texts += [t + " tail" for t in base] + ["a " * 5000]
    rows = [(i * 3 + 1, t, "other", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs).collect()}
    prints = sorted((d, brute_print(t)) for d, t, _, _ in rows)
    groups = brute_groups(prints)
    assert got == {d: (f"{f:016x}", groups[d]) for d, f in prints}
    assert sum(c != d for d, (_, c) in got.items()) > 5


def test_chains_of_links_form_one_component(spark):
    from wardsift.llm.op2_simhash import links
    from wardsift.llm.frames import components

    rng = random.Random(5)
    x, chain = rng.getrandbits(63), []
    for _ in range(60):
        chain.append(x)
        x ^= (1 << rng.randrange(63)) | (1 << rng.randrange(63))
    far = [rng.getrandbits(63) for _ in range(200)]
    prints = spark.createDataFrame([(p,) for p in set(chain + far)], "fp long")
    found = {r.node: r.root for r in components(links(prints)).collect()}
    assert {found[p] for p in chain} == {min(chain)}
    assert not set(far) & set(found)


def test_pairs_within_two_bits_share_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64))
    def sets(p):
        i, a = anchors(p)
        return np.split(a, np.flatnonzero(np.diff(i)) + 1)
    assert all(set(a) & set(b) for a, b in zip(sets(x), sets(y)))


@pytest.mark.parametrize("rows", [[], [(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d")]])
def test_empty_tables_null_ids_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_groups(docs).orderBy(F.col("doc_id").asc_nulls_first(), "component_id").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda v: (v is not None, v or 0))
    if rows:
        assert sorted((r.doc_id or 0, r.component_id) for r in got if r.fingerprint != "0" * 16) == [(0, 4), (4, 4), (4, 4)]
