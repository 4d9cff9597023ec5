import hashlib
import random

import numpy as np
import pytest

from wardsift.llm import op4_suffixes
from wardsift.llm.bwt_merge import Shard, intervals, merge, ordered, symbols
from wardsift.llm.op4_suffixes import suffix_dedup, suffix_digests
from wardsift.llm.text_arrays import byte_sums, span_hash, window_hash


def shards_of(made, step):
    flat = [s for m in made for s in m]
    symbol = symbols(np.frombuffer(b"".join(flat), np.uint8), np.append(0, np.cumsum([len(s) for s in flat])), step)
    cut = np.append(0, np.cumsum([sum(len(s) + 1 for s in m) for m in made]))
    return [Shard(symbol[a:b], np.array([len(s) for s in m]), step) for a, b, m in zip(cut[:-1], cut[1:], made)]


def prefix(a, b, depth):
    n = 0
    while n < min(len(a), len(b), depth) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("letters", [2, 4, 200])
@pytest.mark.parametrize("step", [1, 4, 8, 12])
def test_merged_order_and_common_prefixes(letters, step):
    rng = random.Random(letters)
    made = [[bytes(rng.randrange(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9))] for _ in range(5)]
    made[2][0] = made[0][0]
    shards, rounds = shards_of(made, step), 24 // step
    for own, m in zip(shards, made):
        # By whole symbols; a suffix shorter than a symbol is an end mark, smaller than all symbols.
        def key(f):
            s, i, o = f
            return [tuple(s[k : k + step]) for k in range(0, len(s) - step + 1, step)] + [(-1,), (i, o + len(s) // step * step)]
        want = sorted(((s[o:], i, o) for i, s in enumerate(m) for o in range(len(s) + 1)), key=key)
        assert [(i, o) for _, i, o in want] == list(zip(own.string.tolist(), own.offset.tolist()))
    source, common = merge(shards, rounds)
    at, merged = [0] * len(shards), []
    for z in source.tolist():
        own = shards[z]
        merged.append(made[z][own.string[at[z]]][own.offset[at[z]] :])
        at[z] += 1
    assert [prefix(a, b, step * rounds) // step for a, b in zip(merged, merged[1:])] == common[1:].tolist()
    z, i, o, group = intervals(shards, rounds)
    by_group, by_bytes = {}, {}
    for a, b, c, g in zip(z.tolist(), i.tolist(), o.tolist(), group.tolist()):
        s = made[a][b][c:]
        if len(s) >= 24:
            by_group.setdefault(g, set()).add((a, b, c))
            by_bytes.setdefault(s[:24], set()).add((a, b, c))
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, by_bytes.values()))


def brute(rows, width=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            w = data[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out.append((i, len(data), int(gone.sum()), spans, bytes(data[k] for k in np.flatnonzero(~gone))))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    passages = [word(rng.randint(90, 700)) for _ in range(6)]
    texts = [None, "", "x", "a" * 900, "ab" * 300, "abc" * 31, "\x00" * 250]
    for _ in range(90):
        t = word(rng.randint(0, 900))
        for p in rng.choices(passages, k=rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + p[rng.randint(0, 20) :] + t[at:]
        texts.append(t)
    texts += rng.choices(texts, k=12)
    texts += [t[:200] + "Z" + t[201:] for t in rng.choices(texts[7:], k=12)]
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot", [(1, 50_000), (2, 50_000), (3, 2)])
def test_removed_bytes_equal_brute_force(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, bucket string").repartition(6)
    want = brute(rows)
    digests = sorted(tuple(r) for r in suffix_digests(docs, hot=hot).collect())
    assert digests == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in want]
    assert sum(r[2] for r in want) > 5000
    if seed == 1:
        assert sorted((*r[:4], bytes(r[4])) for r in suffix_dedup(docs).collect()) == want


def test_empty_table_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(80)))
    got = suffix_dedup(spark.createDataFrame([(None, text), (7, text), (7, text)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in got) == [(0, len(text), 1), (7, 0, 0), (7, len(text), 1)]


@pytest.mark.parametrize("limit", [1, 300, 1 << 40, 1 << 62])
def test_keys_sort_with_their_places_as_argsort_does(limit):
    rng = np.random.default_rng(limit % 97)
    for n in (0, 1, 2, 4000):
        keys = rng.integers(0, limit, n)
        keys[: n // 2] = keys[n - n // 2 :]
        got, order = ordered(keys, limit)
        assert (order == np.argsort(keys, kind="stable")).all() and (got == np.sort(keys)).all()


@pytest.mark.parametrize("far", [1, 1 << 50])
def test_lowest_window_of_each_group(far):
    rng = np.random.default_rng(3)
    group, rank, start = rng.integers(0, 400, 3000) * far, rng.integers(0, 50, 3000), rng.integers(0, 130, 3000)
    first = op4_suffixes._first_of_each(group, rank, start)
    assert [x.tolist() for x in op4_suffixes._lowest(group, rank, start)] == [rank[first].tolist(), start[first].tolist()]
    assert [len(x) for x in op4_suffixes._lowest(*(np.zeros(0, np.int64),) * 3)] == [0, 0]


def test_buckets_sort_numbers_and_never_sort_windows_indirectly(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(100, 199))) for _ in range(200)]
    lengths = np.array([len(t) for t in texts])
    longest, lexsort, argsort = [0], np.lexsort, np.argsort
    seen = lambda n, small: longest.append(0 if small else n)
    monkeypatch.setattr(np, "lexsort", lambda keys, *a: (seen(len(keys[0]), False), lexsort(keys, *a))[1])
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: (seen(len(x), x.dtype.itemsize <= 2), argsort(x, *a, **b))[1])
    body = np.frombuffer(b"".join(texts), np.uint8)
    later, = op4_suffixes.later_windows([body], [lengths], [np.arange(200, dtype=np.uint64)], np.array([0]), 100)
    windows = [t[i : i + 100] for t in texts for i in range(len(t) - 99)]
    assert later.sum() == len(windows) - len(set(windows))
    assert max(longest) <= 200


def test_digests_of_all_windows_are_those_of_spans():
    data = np.frombuffer(bytes(random.Random(2).choices(range(256), k=500)), np.uint8)
    sums, at = byte_sums(data), np.arange(len(data) - 23)
    assert (window_hash(sums, 24) == span_hash(sums, at, at + 24)).all() and len(window_hash(byte_sums(data[:5]), 24)) == 0
