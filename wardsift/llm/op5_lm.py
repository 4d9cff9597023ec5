"""Scores of an n-gram model with deleted interpolation.

P(w | u) = a2 c(u w) / c(u) + a1 c(w) / N + a0 / (V + 1).  The weights a depend on the bucket (power of two) of the
context's count.  They are learned by expectation-maximisation: one tenth of the training
texts is deleted from the counts and predicted by what is retained.  Final counts are those of all training texts.

Counting is one exchange of distinct unigrams and bigrams between chunks and buckets (see ``packed``): a bucket
sums what every chunk has counted, and each chunk gets the sums of its own n-grams.  The EM sufficient
statistics are rows (context count, pair count, word count, how many), summed by Spark per pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardsift.llm.frames import Batches, mapped, record, written
from wardsift.llm.packed import REQUESTS, SUMMARY, answer, bucket_bits, chunks_of, from_planes, pack, replies_of, requests, with_replies
from wardsift.llm.text_arrays import LOWER, flat, mix, word_hashes, words

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LEFT, _RIGHT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
BUCKETS = 32
HELD_OUT, DELETED = 0, 9
#: Counts that go with a key: in retained and in deleted training texts, 64 bits each.
FIELDS = 2


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10


def _tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token (words, then one end), hash of the token before it, and row offsets."""
    data, offsets = flat(piece.column("text"))
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    rows = np.arange(len(first) - 1)
    token = np.insert(word_hashes(data, starts, ends), first[1:], END)
    first = first + np.append(rows, len(rows))
    before = np.append(START, token[:-1]) if len(token) else token
    before[first[:-1]] = START
    return token, before, first


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """64-bit digests of word pairs."""
    return mix(before * _LEFT + token * _RIGHT)


def _chunk_tokens(pieces: list[pa.RecordBatch]):
    """Tokens, contexts, fold of each token, and per piece its row offsets."""
    parts = [_tokens(p) for p in pieces]
    folds = [np.repeat(p.column("fold").to_numpy(), np.diff(f)) for p, (_, _, f) in zip(pieces, parts)]
    return np.concatenate([t for t, _, _ in parts]), np.concatenate([b for _, b, _ in parts]), np.concatenate(folds), [f for _, _, f in parts]


def _count(keys: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts in retained and in deleted training texts."""
    distinct, at = np.unique(keys, return_inverse=True)
    n = len(distinct)
    kept = np.bincount(at[(folds != HELD_OUT) & (folds != DELETED)], minlength=n)
    return distinct, np.stack([kept, np.bincount(at[folds == DELETED], minlength=n)], axis=1).astype(np.uint64)


def _sum_group(group: np.ndarray, facts: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    sums = np.zeros((int(group.max(initial=-1)) + 1, FIELDS), np.uint64)
    np.add.at(sums, group, facts)
    return sums[group]


def _counts(pieces: list[pa.RecordBatch], replies: pa.Scalar):
    """Global counts (retained, deleted) of every token, context and pair of a chunk."""
    token, before, folds, firsts = _chunk_tokens(pieces)
    _, where = np.unique(np.concatenate([token, before]), return_inverse=True)
    found = replies_of(replies, 1, FIELDS)[where]
    _, at = np.unique(_pairs(before, token), return_inverse=True)
    return found[: len(token)], found[len(token) : 2 * len(token)], replies_of(replies, 2, FIELDS)[at], folds, firsts


def _retained(counts: np.ndarray) -> np.ndarray:
    return counts[:, 0].astype(np.int64)


def _all(counts: np.ndarray) -> np.ndarray:
    return counts.sum(axis=1).astype(np.int64)


def interpolated_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = 20) -> DataFrame:
    """Per document: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A-Z are lower-cased; tokens are words and one end per text.  Texts whose id has crc32 mod 10 = 0 are held out,
    all others train; remainder 9 is the deleted part for the weights.  Null text is empty (one token, the end); a null id is
    taken as empty text (held out); repeated rows train and are scored row by row; an empty table gives an empty
    result; other columns are ignored.
    """
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), fold(F.col(f"`{id_col}`")).alias("fold"), F.col(f"`{text_col}`").alias("text"))
    packed = pack(narrow, "id", "text", "fold")
    bits = bucket_bits(packed)

    def ask(batches: Batches) -> Batches:
        for chunk, pieces, _ in chunks_of(batches):
            token, before, folds, _ = _chunk_tokens(pieces)
            starts = before == START
            # START is counted as a context only, every other key as a token.
            keys = np.concatenate([token, before[starts]])
            yield from requests(chunk, 1, *_count(keys, np.concatenate([folds, folds[starts]])), bits)
            yield from requests(chunk, 2, *_count(_pairs(before, token), folds), bits)

    replies = written(answer(mapped(packed, ask, REQUESTS), _sum_group, _training_size, FIELDS))
    sums = replies.where((F.col("chunk") == SUMMARY) & (F.col("kind") == 1)).select("reply").toLocalIterator()
    n_kept, n_all, types = (int(n) for n in sum((from_planes(r[0]) for r in sums), np.zeros(3, np.uint64)))
    chunks = with_replies(packed, replies)
    weights = _learn(chunks, n_kept, types, passes)

    def score(batches: Batches) -> Batches:
        for _, pieces, replies in chunks_of(batches):
            of_token, of_context, of_pair, folds, firsts = _counts(pieces, replies)
            c, context, pair = _all(of_token), _all(of_context), _all(of_pair)
            a = weights[_bucket(context)]
            p = a[:, 0] / (types + 1)
            if n_all:
                p = p + a[:, 1] * (c / n_all) + a[:, 2] * np.divide(pair, context, out=np.zeros(len(c)), where=context > 0)
            log_p = np.log10(p)
            base = np.log10((c + 0.1) / (n_all + 0.1 * (types + 1)))
            at = 0
            for piece, first in zip(pieces, firsts):
                own = slice(at, at + int(first[-1]))
                at = own.stop
                fold_of = piece.column("fold").to_numpy()
                yield record(
                    {
                        "id": piece.column("id"),
                        "held_out": fold_of == HELD_OUT,
                        "n_tokens": np.diff(first),
                        "n_known": np.add.reduceat((c[own] > 0).astype(np.int64), first[:-1]),
                        "train_tokens": np.full(piece.num_rows, n_all, np.int64),
                        "base_score": np.add.reduceat(base[own], first[:-1]),
                        "score": np.add.reduceat(log_p[own], first[:-1]),
                    }
                )

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return mapped(chunks, score, schema).withColumnRenamed("id", id_col)


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two of its count."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _training_size(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Retained tokens, all training tokens, and distinct training tokens of a bucket."""
    counts = counts[keys != START]
    return np.array([_retained(counts).sum(), _all(counts).sum(), np.count_nonzero(_all(counts))], np.uint64)


def _learn(chunks: DataFrame, n_kept: int, types: int, passes: int) -> np.ndarray:
    """Weights (uniform, unigram, bigram) per context bucket from the deleted part."""

    def gather(batches: Batches) -> Batches:
        for _, pieces, replies in chunks_of(batches):
            of_token, of_context, of_pair, folds, _ = _counts(pieces, replies)
            cut = folds == DELETED
            facts = np.stack([_retained(x[cut]) for x in (of_context, of_pair, of_token)], axis=1)
            order = np.lexsort(facts.T[::-1])
            facts = facts[order]
            new = np.append(True, (facts[1:] != facts[:-1]).any(axis=1)) if len(facts) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            yield record({"context": facts[at, 0], "pair": facts[at, 1], "word": facts[at, 2], "n": np.diff(np.append(at, len(facts)))})

    seen = mapped(chunks, gather, "context long, pair long, word long, n long")
    seen = written(seen.groupBy("context", "pair", "word").agg(F.sum("n").alias("n")))
    bucket = F.when(F.col("context") > 0, F.least(F.floor(F.log2("context")).cast("int") + 1, F.lit(BUCKETS - 1))).otherwise(0)
    p = (
        F.lit(1.0 / (types + 1)),
        F.col("word") / F.lit(float(max(n_kept, 1))),
        F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0),
    )
    weights = np.tile([0.2, 0.3, 0.5], (BUCKETS, 1))
    weights[0] = [0.4, 0.6, 0.0]
    for _ in range(passes):
        table = [F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, k]]), F.col("bucket") + 1) for k in range(3)]
        shares = [table[k] * p[k] for k in range(3)]
        total = shares[0] + shares[1] + shares[2]
        rows = (
            seen.withColumn("bucket", bucket)
            .select("bucket", "n", *[(F.col("n") * s / total).alias(f"s{k}") for k, s in enumerate(shares)])
            .groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(3)])
        ).collect()
        before = weights.copy()
        for r in rows:
            weights[r["bucket"]] = np.array([r["s0"], r["s1"], r["s2"]]) / r["n"]
        # The uniform part never vanishes, so that every token keeps a probability.
        weights = np.maximum(weights, [1e-6, 0.0, 0.0])
        weights /= weights.sum(axis=1, keepdims=True)
        if np.abs(weights - before).max() < 1e-4:
            break
    return weights
