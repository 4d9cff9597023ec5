"""Mixing to target weights with soft membership.

A softmax classifier, fitted on a bounded sample of the labelled table, gives each document a posterior over
domains.  Rates r >= 0 then minimise
    sum_k (sum_d t_d r_d p_dk - T_k)^2 / S^2 + ridge * sum_d t_d (r_d - 1)^2 / S,
with t_d the tokens of a document, T_k the target tokens of a domain and S all tokens.  The minimiser is
r_d = max(0, 1 - p_d v) for K multipliers v, which Newton steps find: they solve
    ridge * v + T / S = sum_d t_d r_d p_d / S,
so each step is scaled by the weighted posterior products of the documents in use, and a domain with few tokens takes no more
steps than one with many.  Each step is one Spark job that sums K values and K x K products at a few step lengths; a document's
rate follows from its own posterior and v, so no state is kept per document.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wardsift.llm.frames import Batches, mapped, record, texts, written
from wardsift.llm.text_arrays import LOWER, byte_sums, flat, mix, pieces, row_of, span_hash, word_hashes, words

DIMENSIONS = 1 << 18
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: Step lengths that one job tries, and the lowest ridge that ``fit_targets`` goes down to.
LENGTHS = 0.25 ** np.arange(4)
LEAST_RIDGE = 1e-9


def label_domains(labels: DataFrame) -> DataFrame:
    """(``doc_id``, ``domain``) of the labelled table: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features (words with A-Z lower-cased, and the last three bytes of words as they are), their
    row offsets, and words per row."""
    starts, ends, first = words(data, offsets)
    row = np.concatenate([row_of(first)] * 2).astype(np.uint64)
    tails = mix(span_hash(byte_sums(data), np.maximum(starts, ends - 3), ends) + np.uint64(1))
    hashed = np.concatenate([word_hashes(LOWER[data], starts, ends), tails])
    keys = np.unique(row * np.uint64(DIMENSIONS) + (hashed >> np.uint64(46)))
    found = np.searchsorted(keys, np.arange(len(first), dtype=np.uint64) * np.uint64(DIMENSIONS))
    return (keys % np.uint64(DIMENSIONS)).astype(np.int64), found, np.diff(first)


def _logits(weights: np.ndarray, bias: np.ndarray, feature: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(feature) + 1, weights.shape[1]))
    np.cumsum(weights[feature], axis=0, out=sums[1:], dtype=np.float64)
    return sums[offsets[1:]] - sums[offsets[:-1]] + bias


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_classifier(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 6000, min_rows: int = 20, l2: float = 1.0, steps: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (``DIMENSIONS`` x K) and bias from at most ``max_labelled`` labelled rows (smallest id digests).

    Features of fewer than ``min_rows`` sampled rows get no weight, or they would be learned by heart.  A row has at most ``DIMENSIONS`` features, so what the driver gets is bounded by the two parameters.
    """
    chosen = labelled.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_labelled)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id").select("domain", "text")

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            feature, offsets, _ = _features(*flat(piece.column("text")))
            cells = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield record({"domain": piece.column("domain"), "features": pa.array(cells, pa.binary())})

    got = sorted(tuple(r) for r in mapped(rows, run, "domain string, features binary").collect())
    k = len(DOMAINS)
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    if not got:
        return weights.astype(np.float32), bias
    truth = np.eye(k)[[DOMAINS.index(d) for d, _ in got]]
    cells = [np.frombuffer(f, np.int32) for _, f in got]
    feature, offsets = np.concatenate(cells).astype(np.int64), np.append(0, np.cumsum([len(c) for c in cells]))
    row = row_of(offsets)
    common = np.bincount(feature, minlength=DIMENSIONS)[feature] >= min_rows
    feature, row = feature[common], row[common]
    offsets = np.searchsorted(row, np.arange(len(got) + 1))
    used, at = np.unique(feature, return_inverse=True)
    small, speed, bias_speed = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        error = (_softmax(_logits(small, bias, at, offsets)) - truth) / len(got)
        slope = np.stack([np.bincount(at, weights=error[row, j], minlength=len(used)) for j in range(k)], axis=1) + l2 * small / len(got)
        speed += slope**2
        small -= 0.1 * slope / np.sqrt(speed)
        bias_speed += error.sum(axis=0) ** 2
        bias -= 0.1 * error.sum(axis=0) / np.sqrt(bias_speed)
    weights[used] = small
    return weights.astype(np.float32), bias


def posteriors(docs: DataFrame, classifier: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``n_tokens``, ``p0``, ``p1``, ...) of every row, from its whole text."""
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            feature, offsets, n = _features(*flat(piece.column("text")))
            p = _softmax(_logits(*shared.value, feature, offsets))
            yield record({"id": piece.column("id"), "n_tokens": n} | {f"p{k}": p[:, k] for k in range(p.shape[1])})

    return mapped(texts(docs, id_col, text_col), run, f"id {kind}, n_tokens long, " + ", ".join(f"p{k} double" for k in range(len(DOMAINS))))


class Fit(NamedTuple):
    """Multipliers from which ``rates`` gives any rate, the share of all tokens that each domain gets by them, whether
    these shares are the targets (within the tolerance), and how many jobs it took."""

    multipliers: np.ndarray
    reached: np.ndarray
    met: bool
    passes: int


def rates(p: np.ndarray, multipliers: np.ndarray, *_: object) -> tuple[np.ndarray, np.ndarray]:
    """Rate of every document by its posterior, and whether it is above zero."""
    rate = np.maximum(0.0, 1.0 - p @ multipliers)
    return rate, rate > 0


def _sums(known: DataFrame, points: np.ndarray, total: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Per point: squared rates, tokens by domain, and products of posteriors of rates above zero, as shares of all tokens."""
    k = points.shape[1]
    names, width = [f"p{j}" for j in range(k)], 1 + k + k * k

    def run(batches: Batches) -> Batches:
        sums = np.zeros((len(points), width))
        for batch in batches:
            p = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            tokens = batch.column("n_tokens").to_numpy()
            for row, point in zip(sums, points):
                rate, above = rates(p, point)
                row[0] += (tokens * rate) @ rate
                row[1 : 1 + k] += (tokens * rate) @ p
                row[1 + k :] += ((p * (tokens * above)[:, None]).T @ p).ravel()
        yield record({f"s{j}": [x] for j, x in enumerate(sums.ravel())})

    columns = [f"s{j}" for j in range(len(points) * width)]
    row = mapped(known.select("n_tokens", *names), run, ", ".join(f"{c} double" for c in columns)).agg(*[F.sum(c) for c in columns]).first()
    return [(r[0], r[1 : 1 + k], r[1 + k :].reshape(k, k)) for r in np.array(row).reshape(-1, width) / total]


def fit_rates(
    known: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = 1e-4, max_steps: int = 60, tolerance: float = 1e-3, start: np.ndarray | None = None
) -> Fit:
    """The fit of this ``ridge``; ``known`` has ``n_tokens`` and posteriors, ``start`` has multipliers to begin with.

    Ends when every domain's expected tokens are within ``tolerance`` of the target (relative to all tokens; the rates are then
    the closest to one that give these tokens), or at the minimiser, where no slope exceeds a thousandth of ``tolerance``;
    there ``met`` tells whether the targets are reached.  Raises if neither comes within ``max_steps`` jobs.
    """
    k = len(DOMAINS)
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS], float)
    wanted /= wanted.sum()
    total = float(known.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    at = np.zeros(k) if start is None else start
    if not total:
        return Fit(at, np.zeros(k), False, 0)
    points, best, shrink = at[None], None, 1.0
    for passes in range(1, max_steps + 1):
        for point, length, (squares, reached, products) in zip(points, shrink * LENGTHS, _sums(known, points, total)):
            value = ridge / 2 * point @ point + wanted @ point + squares / 2
            slope = ridge * point + wanted - reached
            # A step counts if it lowers the value as a convex one must, or halves the slope where rounding hides that.
            if best is None or value <= best + 1e-4 * length * fall or np.abs(slope).max() <= 0.5 * steepest:
                at, best, steepest, shrink = point, value, np.abs(slope).max(), 1.0
                met = bool(np.abs(reached - wanted).max() < tolerance)
                if met or steepest <= 1e-3 * tolerance:
                    return Fit(at, reached, met, passes)
                ahead = -np.linalg.solve(products + ridge * np.eye(k), slope)
                fall = slope @ ahead
                break
        else:
            shrink *= LENGTHS[-1] / 4
        points = at + shrink * LENGTHS[:, None] * ahead
    raise ValueError(f"mixing rates have not converged within {max_steps} steps: shares {dict(zip(DOMAINS, reached.tolist()))}, steepest slope {steepest:.2g}")


def fit_targets(known: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = 1e-4, **fit: float) -> Fit:
    """``fit_rates``, with ``ridge`` lowered tenfold (to ``LEAST_RIDGE``) as long as its pull towards rates of one keeps a target from being met.

    If none of them meets the targets, which are then taken as infeasible, the fit of the given ridge (least squares) stays, with a
    warning that has the shares reached.
    """
    first = now = fit_rates(known, targets, ridge, **fit)
    while first.passes and not now.met and ridge > LEAST_RIDGE:
        ridge = max(ridge / 10, LEAST_RIDGE)
        now = fit_rates(known, targets, ridge, start=now.multipliers, **fit)
    if now.met or not first.passes:
        return now
    warnings.warn(f"mixing targets are not met, shares of the tokens are {dict(zip(DOMAINS, first.reached.tolist()))}", RuntimeWarning, stacklevel=2)
    return first


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **fit: float
) -> DataFrame:
    """Per document: ``id_col``, ``n_tokens``, ``p_good``, ``p_poor``, ``p_toxic`` and ``rate`` (expected copies).

    ``labelled`` has ``doc_id`` and ``domain``.  Tokens are words of the whole text; null and empty texts have none and the rate
    that their posterior implies.  Null ids and repeated rows are weighed row by row; without labels all posteriors are
    equal; an empty table gives an empty result; other columns are ignored.
    """
    known = written(posteriors(docs, fit_classifier(docs, labelled, id_col, text_col), id_col, text_col))
    return _with_rates(known, fit_targets(known, targets, **fit), id_col)


def _with_rates(known: DataFrame, fitted: Fit, id_col: str) -> DataFrame:
    names = [f"p{j}" for j in range(len(DOMAINS))]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            p = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            yield record({c: batch.column(c) for c in batch.schema.names} | {"rate": rates(p, *fitted)[0]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema) + ", rate double"
    out = mapped(known, run, schema)
    return out.select(F.col("id").alias(id_col), "n_tokens", *[F.col(f"p{j}").alias(f"p_{d}") for j, d in enumerate(DOMAINS)], "rate")


def with_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", **fit: float
) -> DataFrame:
    """``docs`` with all columns and the column ``mix_rate``; texts are read again and not shuffled."""
    classifier = fit_classifier(docs, labelled, id_col, text_col)
    fitted = fit_targets(written(posteriors(docs, classifier, id_col, text_col)), targets, **fit)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at, names = docs.columns.index(text_col), [*docs.columns, "mix_rate"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            filled = pc.fill_null(batch.column(at), "")
            wide = pa.RecordBatch.from_arrays([*batch.columns, filled], names=[str(i) for i in range(batch.num_columns + 1)])
            for piece in pieces([wide], str(batch.num_columns)):
                feature, offsets, _ = _features(*flat(piece.column(batch.num_columns)))
                rate = rates(_softmax(_logits(*shared.value, feature, offsets)), *fitted)[0]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(rate)], names=names)

    return mapped(docs, run, StructType([*docs.schema.fields, StructField("mix_rate", DoubleType())]))
