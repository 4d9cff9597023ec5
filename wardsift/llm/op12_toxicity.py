"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary training texts each get a model of expressions (words and word pairs).  As in Kneser-Ney smoothing an
expression counts by the number of different words that it follows, not by how often it occurs, a discount is taken off, and what
the discounts leave goes to counts that both classes share:

    p_c(e) = max(N_c(e) - D_c, 0) / N_c + m * s(e),     s(e) = (N_0(e) + N_1(e)) / (N_0 + N_1).

``D_1`` is given and ``D_0`` is set so that both classes hand over the same mass ``m``: a rare expression then has the same
probability in both and says nothing, however unequal the classes are.  A text's log-likelihood ratio takes the pair where a model
knows it and backs off to the word.  What a text's typical word shows (its language, its style) is taken off as the median, only what passes a
margin counts, and the sum is normalised by length.  A logistic curve, fitted on training rows that the counts left out, turns it into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardsift.llm.frames import Batches, mapped, record, texts, written
from wardsift.llm.text_arrays import LOWER, flat, mix, pieces, row_of, word_hashes, words

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
_ORDERS = (1, 2)
_LEFT, _RIGHT, _START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0x5851F42D4C957F2D)
#: What is added to a text's words and to its ratio, so that short and neutral texts stay in range.
MORE_WORDS, LEAST_RATIO = 50.0, 1e-3


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _expressions(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
    """Per order the digest of the expression that ends at every word and of the word before it, and the rows' offsets in words.

    At the start of a text the word before is a mark, and so is the first word of a pair.
    """
    starts, ends, first = words(data, offsets)
    word = word_hashes(LOWER[data], starts, ends)
    at = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))

    def before(k: int) -> np.ndarray:
        return np.where(at >= k, np.roll(word, k), _START)

    return {1: word, 2: mix(before(1) * _LEFT + word * _RIGHT)}, {1: before(1), 2: before(2)}, first


def _counts(rows: DataFrame) -> DataFrame:
    """(``kind``, ``e``, ``n0``, ``n1``): different words before every expression, per class, of rows (``label``, ``text``)."""

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            found, before, first = _expressions(*flat(piece.column("text")))
            label = piece.column("label").to_numpy()[row_of(first)]
            for kind in _ORDERS:
                seen = np.unique(np.stack([label.astype(np.uint64), found[kind], before[kind]]), axis=1)
                yield record({"kind": np.full(seen.shape[1], kind, np.int32), "label": seen[0].astype(np.int32), "e": seen[1].view(np.int64), "v": seen[2].view(np.int64)})

    seen = mapped(rows, run, "kind int, label int, e long, v long").distinct()
    return seen.groupBy("kind", "e").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))


def _equal_mass(values: np.ndarray, times: np.ndarray, mass: float) -> float:
    """The discount D with sum(times * min(values, D)) = mass * sum(times * values)."""
    order = np.argsort(values)
    values, times = values[order].astype(float), times[order].astype(float)
    below = np.append(0.0, np.cumsum(values * times))
    left = np.append(np.cumsum(times[::-1])[::-1], 0.0)
    wanted = mass * below[-1]
    at = int(np.searchsorted(below[:-1] + values * left[:-1], wanted))
    return 0.0 if not len(values) else float((wanted - below[min(at, len(values) - 1)]) / left[min(at, len(values) - 1)])


def _ratios(counts: DataFrame, discount: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per order the expressions (sorted digests) that a class knows beyond its discount, with log p_1 / p_0.

    An expression of such a table has more than ``discount`` contexts in a class, so there are fewer of them than training
    words divided by the discount.
    """
    sizes = counts.groupBy("kind", "n0", "n1").count().collect()
    out = {}
    for kind in _ORDERS:
        n0, n1, times = (np.array([r[c] for r in sizes if r["kind"] == kind], np.int64) for c in ("n0", "n1", "count"))
        all0, all1 = int(n0 @ times), int(n1 @ times)
        if not all0 or not all1:
            out[kind] = np.zeros(0, np.uint64), np.zeros(0)
            continue
        mass = float(np.minimum(n1, discount) @ times) / all1
        other = _equal_mass(n0, times, mass)
        known = counts.where((F.col("kind") == kind) & ((F.col("n0") > other) | (F.col("n1") > discount))).select("e", "n0", "n1").toArrow()
        e, n0, n1 = (known.column(c).to_numpy() for c in ("e", "n0", "n1"))
        shared = mass * (n0 + n1) / (all0 + all1)
        ratio = np.log((np.maximum(n1 - discount, 0) / all1 + shared) / (np.maximum(n0 - other, 0) / all0 + shared))
        order = np.argsort(e.view(np.uint64))
        out[kind] = e.view(np.uint64)[order], ratio[order]
    return out


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, ratio = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[at] == keys
    return hit, np.where(hit, ratio[at], 0.0)


def excess(ratios: dict[int, tuple[np.ndarray, np.ndarray]], margin: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row the length-normalised log-likelihood ratio beyond the row's median and ``margin``."""
    found, _, first = _expressions(data, offsets)
    known, ratio = _look_up(ratios[2], found[2])
    ratio = np.where(known, ratio, _look_up(ratios[1], found[1])[1])
    row, n = row_of(first), np.diff(first)
    ordered = ratio[np.lexsort((ratio, row))]
    some = np.flatnonzero(n)
    median = np.zeros(len(n))
    median[some] = (ordered[first[:-1][some] + (n[some] - 1) // 2] + ordered[first[:-1][some] + n[some] // 2]) / 2
    over = np.maximum(ratio - median[row] - margin, 0.0)
    return np.bincount(row, weights=over, minlength=len(n)) / (n + MORE_WORDS)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps; the ridge keeps a separable sample finite."""
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -500, 500)))
        slope = design.T @ (p - y) + ridge * beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), slope)
        beta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0]), float(beta[1])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 12_000,
    max_words: int = 8_000_000,
    discount: float = 3.0,
    margin: float = 1.0,
) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up) of every row, from its whole text.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; rows with another or no label or id are left out; an id with both labels is taken as
    toxic).  Rows whose id has crc32 mod 5 = 0 are held out and never learned from; of the other labelled rows at most ``max_labelled`` are
    taken, by smallest digest of the id, as long as their words sum up to at most ``max_words``, so the models, which are
    broadcast, have fewer than ``max_words`` expressions.  Those with remainder 1 fit the curve, the others the counts.  The score depends on
    the text alone.  If the curve's rows lack a class, every score is the share of toxic rows among those taken (one half of none).

    Null text is empty and, like an empty one, shows nothing; a null id counts as empty text (held out); repeated rows are scored one by one;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark, kind = docs.sparkSession, docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id")) != HELD_OUT)).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    taken = written(texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("id", "label", fold(F.col("id")).alias("fold"), "text"))
    # As many rows as were chosen (more where ids repeat): a narrow table of their lengths says which of them are within the limit.
    n_words = F.size(F.filter(F.split(F.col("text").cast("string"), "[ \t\n\x0b\f\r]"), lambda w: w != ""))
    sized = taken.select("id", n_words.alias("n")).groupBy("id").agg(F.sum("n").alias("n"))
    within = sized.withColumn("sum", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))).where(F.col("sum") <= max_words)
    rows = taken.join(F.broadcast(within.select("id")), "id")

    ratios = _ratios(written(_counts(rows.where(F.col("fold") != CALIBRATION).select("label", "text"))), discount)
    shared = spark.sparkContext.broadcast(ratios)

    def measure(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            x = excess(shared.value, margin, *flat(piece.column("text")))
            yield record({"label": piece.column("label"), "x": np.log(x + LEAST_RATIO)})

    curve = mapped(rows.where(F.col("fold") == CALIBRATION).select("label", "text"), measure, "label int, x double").toArrow()
    x, y = curve.column("x").to_numpy(), curve.column("label").to_numpy()
    if len(set(y.tolist())) == 2:
        at, by = _logistic(x, y)
    else:
        toxic, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
        share = toxic / n if n else 0.5
        at, by = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            x = np.log(excess(shared.value, margin, *flat(piece.column("text"))) + LEAST_RATIO)
            score = 1.0 / (1.0 + np.exp(-np.clip(at + by * x, -500, 500)))
            yield record({"id": piece.column("id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    scored = mapped(texts(docs, id_col, text_col), run, f"id {kind}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id")) == HELD_OUT).alias("held_out"), "score", "predicted")
