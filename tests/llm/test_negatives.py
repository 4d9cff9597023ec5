import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from wardsift.llm.four_russians import pack_planes, scores, subset_sums, unpack_planes
from wardsift.llm.op13_negatives import RESULT, hard_negatives

COLUMNS = "vec_id long, embedding array<float>, label int, planes string"
RELABELLED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def brute(rows):
    known = []
    for i, vector, label, _ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, own, q in known:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in known if i != a)
        for s, p, _ in [r for r in scored if r[2] == own][:5]:
            near = [(i, -t) for t, i, label in scored if label != own and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(near)]
    return sorted(out)


def test_tables_give_exact_products():
    rng = np.random.default_rng(5)
    for bound, dtype in ((3, np.int32), (700, np.int32), (2**25, np.int64)):
        a, b = rng.integers(-bound, bound + 1, (9, 24)), rng.integers(-bound, bound + 1, (50, 24))
        packed = pack_planes(b, bound.bit_length() + 1)
        assert (unpack_planes(packed) == b).all()
        assert (scores(subset_sums(a, dtype), packed) == b @ a.T).all()


def rows_of(n, dims, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = 1 if rng.random() < 0.4 else rng.randrange(labels)
        vector = [c + rng.gauss(0, 0.4) for c in centres[label]]
        out.append((i, vector, label, "x"))
    for i in range(0, n, 9):  # copies of one vector, and ties
        out[i] = (i, out[1][1], out[i][2], "y")
    return out


def test_rows_equal_brute_force(spark):
    rows = rows_of(700, 19, 3)
    rows[5] = (5, None, 1, "")
    rows[6] = (6, [float("nan")] * 19, 1, "")
    rows[8] = (8, [None] + [0.1] * 18, 1, "")
    rows[10] = (10, [0.2] * 19, None, "")
    rows[11] = (11, [float("inf")] * 19, 2, "")
    rows[12] = (12, [0.5] * 7, 2, "")
    rows += [(None, [0.1] * 19, 1, ""), rows[20], rows[20], rows[300], (400, [0.3] * 19, 2, "")]
    got = hard_negatives(spark.createDataFrame(rows, COLUMNS).repartition(5), label=F.expr(RELABELLED))
    want = brute(rows)
    assert got.columns == [c.split()[0] for c in RESULT.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 200
    small = hard_negatives(spark.createDataFrame(rows, COLUMNS), label=F.expr(RELABELLED), block=3)
    assert sorted(tuple(r) for r in small.collect()) == want


def test_empty_tables_single_rows_and_large_components(spark):
    assert hard_negatives(spark.createDataFrame([], COLUMNS)).count() == 0
    assert hard_negatives(spark.createDataFrame([(0, [], 1, "")], COLUMNS)).count() == 0
    assert hard_negatives(spark.createDataFrame([(0, [1.0], 1, "")], COLUMNS)).count() == 0
    few = [(100, [1000.0, -3.0], 1, ""), (2, [900.0, 5.5], 1, ""), (1, [500.0, 1.0], 2, ""), (3, [-500.0, 1.0], 2, "")]
    assert [tuple(r) for r in hard_negatives(spark.createDataFrame(few, COLUMNS), label=F.expr(RELABELLED)).collect()] == brute(few)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives(spark.createDataFrame([(0, [1e30], 1, "")], COLUMNS))


def test_query_equals_sql_over_whole_table(spark):
    import wardsift.llm.queries  # noqa: F401

    assert compare(spark, "/root/testdata/sf0.01", "op13_negatives")[0]
