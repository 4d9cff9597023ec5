"""Substring dedup on words by recompression (see ``recompression``).

A window of ``width`` words occurs twice only if every symbol that it holds with all the words that fix it occurs
twice.  First, all chunks exchange the names of high-level symbols (three words or more): windows with a unique symbol
are out.  Then the other windows are exchanged by the digest of their words, each chunk
sending a window once with its first document; only windows whose first occurrence lies elsewhere are removed.
Frequent passages are met once per chunk, so they do not gather in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardsift.llm.frames import Batches, mapped, record, written
from wardsift.llm.packed import REQUESTS, answer, bucket_bits, chunks_of, is_first, is_repeated, pack, replies_of, requests, with_replies
from wardsift.llm.recompression import recompress
from wardsift.llm.text_arrays import flat, prefix_sums, row_of, span_hash, word_hashes, words

ROUNDS = 3
LEAST_WORDS = 3
NULL_LAST = np.uint64(2**64 - 1)


def order_of(ids: pa.Array) -> np.ndarray:
    """64-bit integers that sort as the ids; nulls come last."""
    valid = np.asarray(ids.is_valid())
    values = np.asarray(ids.fill_null(0).cast(pa.int64())).astype(np.uint64) + np.uint64(2**63)
    return np.where(valid, values, NULL_LAST)


class _Chunk:
    """The words of a chunk: hashes, rows in id order and windows."""

    def __init__(self, pieces: list[pa.RecordBatch], width: int):
        parts, hashes, firsts, at = [], [], [np.zeros(1, np.int64)], 0
        for piece in pieces:
            data, offsets = flat(piece.column("text"))
            starts, ends, first = words(data, offsets)
            parts.append((data, starts, ends, first))
            hashes.append(word_hashes(data, starts, ends))
            firsts.append(first[1:] + at)
            at += int(first[-1])
        self.parts, self.width = parts, width
        self.hashes, self.first = np.concatenate(hashes), np.concatenate(firsts)
        self.row = row_of(self.first)
        self.order = np.concatenate([order_of(p.column("id")) for p in pieces])
        self.stop = np.repeat(self.first[1:], np.diff(self.first))

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and fixing words of the symbols that are asked for."""
        levels = recompress(self.hashes, self.row, ROUNDS)[1:]
        if not levels:
            return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        strong = [(s.end - s.start >= LEAST_WORDS) & (s.need_end - s.need_start <= self.width) for s in levels]
        return tuple(np.concatenate([getattr(s, k)[m] for s, m in zip(levels, strong)]) for k in ("name", "need_start", "need_end"))

    def candidates(self, repeated: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a unique symbol, and their digests."""
        name, low, high = self.symbols()
        _, at = np.unique(name, return_inverse=True)
        unique = replies_of(repeated, 1)[at] == 0 if len(name) else np.zeros(0, bool)
        killed = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(killed, np.maximum(high[unique] - self.width, 0), 1)
        np.add.at(killed, low[unique] + 1, -1)
        open_ = np.arange(len(self.hashes)) + self.width <= self.stop
        start = np.flatnonzero(open_ & (np.cumsum(killed)[:-1] == 0))
        return start, span_hash(prefix_sums(self.hashes), start, start + self.width)

    def firsts(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal windows the first in id order: index into ``start`` by sorted key; and the group of every window."""
        rank = np.empty(len(self.order), np.int64)
        rank[np.argsort(self.order, kind="stable")] = np.arange(len(self.order))
        order = np.lexsort((start, rank[self.row[start]], key))
        new = np.append(True, np.diff(key[order]) != 0) if len(order) else np.zeros(0, bool)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group

    def removed(self, replies: pa.Scalar) -> np.ndarray:
        """Per word: is it covered by a window that also starts earlier?"""
        start, key = self.candidates(replies)
        first, group = self.firsts(start, key)
        again = np.ones(len(start), bool)
        again[first] = replies_of(replies, 2) == 0
        span = np.zeros(len(self.hashes), np.int64)
        span[start[again]] = self.width
        at = np.arange(len(span))
        return np.maximum.accumulate(at + span) > at if len(span) else np.zeros(0, bool)


def _answered(docs: DataFrame, id_col: str, text_col: str, width: int, *more: str) -> DataFrame:
    """Chunks of ``docs`` with the replies that ``_Chunk.removed`` needs."""
    packed = pack(docs, id_col, text_col, *more)
    bits = bucket_bits(packed)

    def ask_symbols(batches: Batches) -> Batches:
        for chunk, pieces, _ in chunks_of(batches):
            keys, counts = np.unique(_Chunk(pieces, width).symbols()[0], return_counts=True)
            yield from requests(chunk, 1, keys, np.minimum(counts, 2), bits)

    def ask_windows(batches: Batches) -> Batches:
        for chunk, pieces, replies in chunks_of(batches):
            own = _Chunk(pieces, width)
            start, key = own.candidates(replies)
            first, _ = own.firsts(start, key)
            yield from requests(chunk, 2, key[first], own.order[own.row[start[first]]], bits)

    repeated = written(answer(mapped(packed, ask_symbols, REQUESTS), is_repeated))
    first = answer(mapped(with_replies(packed, repeated), ask_windows, REQUESTS), is_first)
    return with_replies(packed, repeated.union(written(first)))


def _kept_texts(own: _Chunk, removed: np.ndarray):
    """Per row, in order: kept words joined by one space."""
    at = 0
    for data, starts, ends, first in own.parts:
        keep = ~removed[at : at + len(starts)]
        at += len(starts)
        length = (ends - starts)[keep]
        begin = np.cumsum(length + 1) - (length + 1)
        out = np.full(int((length + 1).sum()), 32, np.uint8)
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[inner + np.repeat(begin, length)] = data[inner + np.repeat(starts[keep], length)]
        joined = out.tobytes()
        kept = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        edge = np.append(begin, len(out))[kept[first]]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield joined[a : max(a, b - 1)]


def _row_counts(own: _Chunk, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[own.first[1:]] - total[own.first[:-1]]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Per document: ``id_col``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    A word is removed if it lies in a window of ``width`` words whose sequence also starts earlier: in a document with a
    smaller id (an integer), or earlier in the same one; windows are judged on the input.  Null and
    empty texts have no words.  Null ids come last; rows with equal ids are different documents in the order
    in which they are stored.  An empty table gives an empty result; other columns are ignored.
    """
    return _results(docs, id_col, text_col, width, "kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """As ``substring_dedup``, with ``kept_sha256`` in place of the kept text."""
    return _results(docs, id_col, text_col, width, "kept_sha256 string")


def _results(docs: DataFrame, id_col: str, text_col: str, width: int, last: str) -> DataFrame:
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    name, digest = last.split()[0], last.startswith("kept_sha256")

    def run(batches: Batches) -> Batches:
        for _, pieces, replies in chunks_of(batches):
            own = _Chunk(pieces, width)
            removed = own.removed(replies)
            n_removed, n_words = _row_counts(own, removed), np.diff(own.first)
            texts, at = _kept_texts(own, removed), 0
            for piece in pieces:
                kept = [next(texts) for _ in range(piece.num_rows)]
                span = slice(at, at + piece.num_rows)
                at = span.stop
                value = pa.array([hashlib.sha256(t).hexdigest() for t in kept]) if digest else pa.array(kept, pa.binary())
                yield record({"id": piece.column("id"), "n_words": n_words[span], "n_removed": n_removed[span], name: value})

    out = mapped(_answered(docs, id_col, text_col, width), run, f"id {kind}, n_words long, n_removed long, {last}")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """``docs`` with all columns; a text that loses words becomes its kept words joined by one space."""
    names = docs.columns
    others = [c for c in names if c not in (id_col, text_col)]
    tagged = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{text_col}`").isNull().alias("was_null"),
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)],
    )
    columns = ["id", "was_null", *[f"c{k}" for k in range(len(others))]]
    schema = ", ".join(f"{c} {tagged.schema[c].dataType.simpleString()}" for c in columns) + ", text binary"

    def run(batches: Batches) -> Batches:
        for _, pieces, replies in chunks_of(batches):
            own = _Chunk(pieces, width)
            removed = own.removed(replies)
            touched = _row_counts(own, removed) > 0
            texts, at = _kept_texts(own, removed), 0
            for piece in pieces:
                old = piece.column("text").to_pylist()
                new = [k if touched[at + i] else old[i] for i, k in enumerate(next(texts) for _ in old)]
                at += len(old)
                yield record({c: piece.column(c) for c in columns} | {"text": pa.array(new, pa.binary())})

    out = mapped(_answered(tagged, "id", "text", width, *columns[1:]), run, schema)
    back = {id_col: F.col("id"), text_col: F.when(~F.col("was_null"), F.col("text").cast("string"))}
    back |= {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return out.select(*[back[c].alias(c) for c in names])
