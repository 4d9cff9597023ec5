"""Hard-negative mining with exact Four-Russians scores.

Vectors are written once as bit planes (see ``four_russians``).  Anchors are taken in numbered blocks of a fixed size, so what
is broadcast at a time has a bound.  A block makes two passes over the planes, without a shuffle of vectors: the first scores
the rows of an anchor's own label and finds its positives, the second scores all other rows against
the bounds that these positives set.  Each task keeps the best few rows per anchor (and positive) and Spark ranks what the tasks
have kept, so no group of rows comes together, however frequent a label or a vector is.  Every pair of anchor and row is scored once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardsift.llm.four_russians import GROUP, pack_planes, scores, subset_sums, unpack_planes
from wardsift.llm.frames import Batches, mapped, numbered, record, written

SCALE = 256
#: Anchors of a block (what a pass broadcasts), anchors that share a table, and candidates that are scored at a time.
BLOCK, TABLE, STEP = 1 << 15, 64, 2048
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
POSITIVES = "number long, anchor_id long, positive_id long, positive_score long"
NEGATIVES = "number long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(``id``, ``label``, ``vector`` as doubles) of the rows with an id, a label and a vector of finite components."""
    wide = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return wide.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """Columns of ``RESULT``: per anchor and positive the first ``negatives`` rows of another label whose score is between
    ``low`` and ``high`` percent of the positive's, by score, then smaller id.

    ``label`` is an expression over ``vectors`` (its column ``label`` if absent).  Components become floor(256 x), x as double;
    anchors are the rows whose id is divisible by ``anchor_every``; an anchor's positives are its first ``positives`` other rows of
    its label.  Rows without id, label or vector, or with a null or non-finite component, take no part; a shorter vector is
    filled up with zeros.  A row with the anchor's id is neither its positive nor its negative; other repeated rows count one by one,
    and a repeated anchor is mined row by row.  Equal scores and ids are ranked in any order, which gives the same rows.  Scores that could pass
    64 bits raise an error.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    known = usable(vectors, id_col, vector_col, F.col("label") if label is None else label)
    quantised = F.transform("vector", lambda x: F.abs(x))
    most, width = known.agg(F.max(F.array_max(quantised)), F.max(F.size("vector"))).first()
    groups = -(-(width or 0) // GROUP)
    if not groups:
        return spark.createDataFrame([], RESULT)
    bound = int(most * SCALE) + 1
    if groups * GROUP * bound**2 >= 2**62:
        raise ValueError("scores of these components do not fit 64 bits")
    planes = bound.bit_length() + 1
    dtype = np.int32 if groups * GROUP * bound**2 < 2**30 else np.int64
    packed = written(mapped(known, _packing(planes, groups), "id long, label long, planes binary"))
    anchors = numbered(packed.where(F.col("id") % anchor_every == 0))
    total = anchors.count()
    found = []
    for at in range(0, total, block):
        rows = anchors.where(F.col("number").between(at, at + block - 1)).orderBy("label", "number").toArrow()
        names = ("number", "id", "label")
        part = {n: rows.column(n).to_numpy().astype(np.int64) for n in names} | {"planes": _matrix(rows.column("planes").combine_chunks(), planes, groups)}
        shared = spark.sparkContext.broadcast(part)
        best = mapped(packed, _positives(shared, planes, groups, dtype, positives), POSITIVES)
        best = _first(best, ["number"], "positive_score", "positive_id", positives)
        bounds = spark.sparkContext.broadcast(_bounds(part["number"], best.collect(), positives, low, high))
        least = mapped(packed, _negatives(shared, bounds, planes, groups, dtype, positives, negatives), NEGATIVES)
        least = _first(least, ["number", "place"], "negative_score", "negative_id", negatives)
        found.append(least.select("anchor_id", "positive_id", F.col("_rank").alias("rank"), "negative_id", "positive_score", "negative_score"))
    if len(found) > 1:
        found = [written(f) for f in found]
    out = spark.createDataFrame([], RESULT) if not found else found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _first(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)


def _packing(planes: int, groups: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                vectors = part.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy().astype(np.int64))
                values = np.zeros((part.num_rows, groups * GROUP), np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                values[row, place] = np.floor(vectors.flatten().to_numpy() * SCALE)
                cells = pack_planes(values, planes).reshape(part.num_rows, -1)
                yield record({"id": part.column("id"), "label": part.column("label"), "planes": pa.array([c.tobytes() for c in cells], pa.binary())})

    return run


def _matrix(cells: pa.Array, planes: int, groups: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), planes, groups)


def _steps(batches: Batches, planes: int, groups: int):
    """Ids, labels and planes of at most ``STEP`` candidates at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("planes"), planes, groups)


def _tables(anchors: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Runs of anchors (sorted by label) that have one label and share a table."""
    label = anchors["label"]
    edges = np.append(np.append(0, np.flatnonzero(np.diff(label)) + 1), len(label))
    return [(a, min(a + TABLE, end)) for start, end in zip(edges[:-1], edges[1:]) for a in range(start, end, TABLE)]


class _Best:
    """The first ``k`` (score, id) per slot, by score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), LEAST), np.full((slots, k), MOST)

    def add(self, slots: slice, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take up (candidates, slots) scores where ``allowed``."""
        k = self.score.shape[1]
        worst, tie = self.score[slots, -1], self.id[slots, -1]
        take = allowed & (score >= worst)
        take &= (score > worst) | (ids[:, None] < tie)
        if len(ids) > k and np.count_nonzero(take) > 4 * k * take.shape[1]:
            held = np.where(take, score, LEAST)
            take &= held >= np.partition(held, len(ids) - k, axis=0)[len(ids) - k]
        row, slot = np.nonzero(take)
        if not len(row):
            return
        changed = np.unique(slot)
        old = changed + slots.start
        all_slot = np.concatenate([np.repeat(changed, k), slot])
        all_score = np.concatenate([self.score[old].ravel(), score[row, slot].astype(np.int64)])
        all_id = np.concatenate([self.id[old].ravel(), ids[row]])
        order = np.lexsort((all_id, -1 - all_score, all_slot))
        head = np.searchsorted(all_slot[order], changed)
        chosen = order[head[:, None] + np.arange(k)]
        self.score[old], self.id[old] = all_score[chosen], all_id[chosen]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.score > LEAST)


def _positives(shared, planes: int, groups: int, dtype: type, k: int):
    def run(batches: Batches) -> Batches:
        anchors = shared.value
        best = _Best(len(anchors["id"]), k)
        for ids, label, packed in _steps(batches, planes, groups):
            for a, b in _tables(anchors):
                own = np.flatnonzero(label == anchors["label"][a])
                if len(own):
                    got = scores(subset_sums(unpack_planes(anchors["planes"][a:b]), dtype), packed[own])
                    best.add(slice(a, b), got, ids[own], ids[own][:, None] != anchors["id"][a:b])
        slot, place = best.rows()
        yield record({"number": anchors["number"][slot], "anchor_id": anchors["id"][slot], "positive_id": best.id[slot, place], "positive_score": best.score[slot, place]})

    return run


def _bounds(numbers: np.ndarray, found: list, k: int, low: int, high: int) -> dict[str, np.ndarray]:
    """Per anchor of a block and place of a positive: its id and score, and the least and greatest score of its negatives."""
    at = {int(n): i for i, n in enumerate(numbers)}
    ids, score = np.zeros((len(numbers), k), np.int64), np.zeros((len(numbers), k), np.int64)
    least, most = np.full((len(numbers), k), MOST), np.full((len(numbers), k), LEAST)
    for r in found:
        cell = at[r["number"]], r["_rank"] - 1
        ids[cell], score[cell] = r["positive_id"], r["positive_score"]
        least[cell], most[cell] = -(-low * r["positive_score"] // 100), high * r["positive_score"] // 100
    return {"id": ids, "score": score, "least": least, "most": most}


def _negatives(shared, bounds, planes: int, groups: int, dtype: type, k: int, n: int):
    def run(batches: Batches) -> Batches:
        anchors, of = shared.value, bounds.value
        best = [_Best(len(anchors["id"]), n) for _ in range(k)]
        for ids, label, packed in _steps(batches, planes, groups):
            for a, b in _tables(anchors):
                other = np.flatnonzero(label != anchors["label"][a])
                if not len(other):
                    continue
                got = scores(subset_sums(unpack_planes(anchors["planes"][a:b]), dtype), packed[other])
                apart = ids[other][:, None] != anchors["id"][a:b]
                for place in range(k):
                    least, most = of["least"][a:b, place], of["most"][a:b, place]
                    best[place].add(slice(a, b), got, ids[other], apart & (got >= least) & (got <= most))
        for place, kept in enumerate(best):
            slot, at = kept.rows()
            yield record(
                {
                    "number": anchors["number"][slot],
                    "anchor_id": anchors["id"][slot],
                    "place": np.full(len(slot), place, np.int32),
                    "positive_id": of["id"][slot, place],
                    "positive_score": of["score"][slot, place],
                    "negative_id": kept.id[slot, at],
                    "negative_score": kept.score[slot, at],
                }
            )

    return run
