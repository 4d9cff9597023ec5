"""Suffix-array dedup of byte strings by merged Burrows-Wheeler transforms (see ``bwt_merge``).

Every window of ``width`` bytes has an anchor: its smallest ``GRAM``-byte substring by digest, the leftmost of equals.
Equal windows have equal anchors, so the windows can be dealt into buckets by anchor, and each bucket
is a collection of its own.  Consecutive windows with one anchor are a context of less than 2 * width bytes.

1. Chunks exchange the digests of their anchors; a window whose anchor occurs once cannot repeat.
2. Each chunk sends every other distinct context once to its bucket.  A bucket parts its distinct contexts into
   shards, builds their transforms and merges them; intervals with a common prefix of ``width`` hold equal windows, and all but the
   first are told to their chunk.

Contexts of an anchor with more than ``hot`` different ones would fill one bucket; their windows go by digest through
many buckets instead (``is_first``), with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardsift.llm.bwt_merge import Shard, intervals, symbols
from wardsift.llm.frames import Batches, mapped, record, written
from wardsift.llm.op6_substrings import order_of
from wardsift.llm.packed import REQUESTS, SUMMARY, answer, bucket_bits, chunks_of, from_planes, is_first, pack, planes, replies_of, requests, with_replies
from wardsift.llm.text_arrays import byte_sums, flat, mix, span_hash, window_hash

GRAM = 24
PLACE_BITS = 32
HOT = 50_000
SHARD_BYTES = 1 << 17
#: Bytes by which a refinement deepens the order: the first of these that divides the window.
STEPS = (20, 10, 8, 6, 5, 4, 3, 2)
#: Contexts are longer in all than the windows they hold, so a bucket stands for this share of a packed bucket's text.
FINER = 1


class _Contexts:
    """Contexts of a chunk: rows, first and last window start (in the piece), digests of anchor and content."""

    def __init__(self, pieces: list[pa.RecordBatch], width: int):
        self.width = width
        self.texts = [flat(p.column("text")) for p in pieces]
        self.order = np.concatenate([order_of(p.column("id")) for p in pieces])
        parts, row = [], 0
        for number, (data, offsets) in enumerate(self.texts):
            own_row, first, last, anchor, content = _contexts(data, offsets, width)
            parts.append((np.full(len(first), number), own_row + row, first, last, anchor, content))
            row += len(offsets) - 1
        self.piece, self.row, self.first, self.last, self.anchor, self.content = (np.concatenate(c) for c in zip(*parts))
        rank = np.empty(len(self.order), np.int64)
        rank[np.argsort(self.order, kind="stable")] = np.arange(len(self.order))
        self.rank = rank[self.row]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors with the contexts to expect: 1 if it occurs once, else its different contexts, 2 at least."""
        order = np.lexsort((self.content, self.anchor))
        anchor, content = self.anchor[order], self.content[order]
        new = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
        head = np.flatnonzero(new)
        different = np.append(0, np.cumsum(new | np.append(True, content[1:] != content[:-1])[: len(anchor)]))
        ends = np.append(head[1:], len(anchor))
        return anchor[head], np.where(ends - head == 1, 1, np.maximum(2, different[ends] - different[head])).astype(np.uint64)

    def sort(self, replies: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts to compare: first of each content, in the order sent; copies of them; contexts of hot anchors."""
        seen = replies_of(replies, 1)[np.unique(self.anchor, return_inverse=True)[1]] if len(self.anchor) else np.zeros(0, np.uint64)
        shared, hot = np.flatnonzero(seen == 1), np.flatnonzero(seen == 2)
        order = shared[np.lexsort((self.first[shared], self.rank[shared], self.content[shared]))]
        new = np.append(True, np.diff(self.content[order]) != 0) if len(order) else np.zeros(0, bool)
        return order[new], order[~new], hot

    def sent(self, firsts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """First contexts by bucket, then document and place; and their buckets."""
        bucket = (mix(self.anchor[firsts]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(firsts), np.int64)
        order = np.lexsort((self.first[firsts], self.rank[firsts], bucket))
        return firsts[order], bucket[order]

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Content and lengths of contexts."""
        lengths = self.last[at] + self.width - self.first[at]
        parts = [self.texts[p][0][f : f + n] for p, f, n in zip(self.piece[at].tolist(), self.first[at].tolist(), lengths.tolist())]
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), lengths

    def hot_windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece, start, digest and rank of all windows of these contexts."""
        n = self.last[hot] - self.first[hot] + 1
        start = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        piece, key = np.repeat(self.piece[hot], n), np.zeros(len(start), np.uint64)
        for number in np.unique(piece):
            own = piece == number
            key[own] = span_hash(byte_sums(self.texts[number][0]), start[own], start[own] + self.width)
        return piece, start, key, np.repeat(self.rank[hot], n)

    def removed(self, replies: pa.Scalar, bits: int) -> list[np.ndarray]:
        """Per piece and byte: is it covered by a window that also starts earlier?"""
        firsts, copies, hot = self.sort(replies)
        firsts, _ = self.sent(firsts, bits)
        n = self.last[firsts] - self.first[firsts] + 1
        told = [r["reply"] for r in (replies.as_py() or []) if r["kind"] == 2]
        flags = np.concatenate([np.zeros(0, bool)] + [_unbits(t) for t in told])
        start = np.repeat(self.first[firsts] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        again = [(np.repeat(self.piece[firsts], n)[flags], start[flags])]
        m = self.last[copies] - self.first[copies] + 1
        again.append((np.repeat(self.piece[copies], m), np.repeat(self.first[copies] - (np.cumsum(m) - m), m) + np.arange(m.sum())))
        if len(hot):
            piece, start, key, rank = self.hot_windows(hot)
            first = _first_of_each(key, rank, start)
            flags = np.ones(len(key), bool)
            flags[first] = replies_of(replies, 3) == 0
            again.append((piece[flags], start[flags]))
        out = []
        for number, (data, _) in enumerate(self.texts):
            span = np.zeros(len(data), bool)
            for piece, start in again:
                span[start[piece == number]] = True
            at = np.arange(len(data))
            reach = np.maximum.accumulate(np.where(span, at + self.width, 0)) if len(data) else at
            out.append(reach > at)
        return out


def _first_of_each(key: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    order = np.lexsort((start, rank, key))
    return order[np.append(True, np.diff(key[order]) != 0)] if len(order) else order


def _lowest(group: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest (rank, start) of each group; the three are sorted as one number where they fit into 63 bits."""
    ranks, starts = (int(x.max(initial=0)).bit_length() for x in (rank, start))
    if int(group.max(initial=0)).bit_length() + ranks + starts > 63:
        first = _first_of_each(group, rank, start)
        return rank[first], start[first]
    both = np.sort((group << ranks | rank) << starts | start)
    own = both >> ranks + starts
    both = both[np.append(True, own[1:] != own[:-1])[: len(own)]]
    return both >> starts & (1 << ranks) - 1, both & (1 << starts) - 1


def _contexts(data: np.ndarray, offsets: np.ndarray, width: int):
    """Row, first and last window start, anchor digest and content digest of every context of a piece."""
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = width - GRAM + 1
    if len(data) < width:
        return empty
    sums = byte_sums(data)
    digest = window_hash(sums, GRAM)
    low = digest & ~np.uint64((1 << PLACE_BITS) - 1)
    low |= np.arange(len(low), dtype=np.uint64)
    reach = 1
    while 2 * reach <= grams:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if reach < grams:
        low = np.minimum(low[: len(low) - (grams - reach)], low[grams - reach :])
    sizes = np.diff(offsets)
    inside = np.maximum(sizes - width + 1, 0)
    starts = np.repeat(np.tile([True, False], len(sizes)), np.stack([inside, sizes - inside], axis=1).ravel())[: len(low)]
    same = np.zeros(len(low) + 1, bool)  # a window and the one before it have one anchor; windows beside each other share a row
    same[1:-1] = (low[1:] == low[:-1]) & starts[1:] & starts[:-1]
    first, last = np.flatnonzero(starts & ~same[:-1]), np.flatnonzero(starts & ~same[1:])
    anchor = (low[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    return np.searchsorted(offsets, first, "right") - 1, first, last, digest[anchor], span_hash(sums, first, last + width)


def _bits(flags: np.ndarray) -> bytes:
    raw = np.packbits(flags).tobytes()
    return len(flags).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unbits(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], (n + 7) // 8, "zstd", asbytes=True)
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _count_hot(keys: np.ndarray, replies: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(replies == 2)], np.uint64)


CONTEXTS = "bucket long, chunk long, orders binary, lengths binary, body binary, size long"


def later_windows(bodies: list[np.ndarray], lengths: list[np.ndarray], orders: list[np.ndarray], chunks: np.ndarray, width: int) -> list[np.ndarray]:
    """Per sender, for all windows of its contexts: does the window occur earlier in the bucket?

    Senders list contexts by document and place; chunk numbers decide between documents of one order.
    """
    sender = np.repeat(np.arange(len(lengths)), [len(n) for n in lengths])
    length, order = np.concatenate(lengths), np.concatenate(orders)
    place = np.concatenate([np.arange(len(n)) for n in lengths])
    data = np.concatenate(bodies)
    offsets = np.append(0, np.cumsum(length))
    content = span_hash(byte_sums(data), offsets[:-1], offsets[1:])
    rank = np.empty(len(length), np.int64)
    rank[np.lexsort((place, chunks[sender], order))] = np.arange(len(length))
    distinct = _first_of_each(content, rank, place)
    later = np.ones(int((length - width + 1).sum()), bool)
    window_at = np.append(0, np.cumsum(length - width + 1))
    own = np.append(0, np.cumsum(length[distinct]))
    pick = np.arange(own[-1]) + np.repeat(offsets[distinct] - own[:-1], length[distinct])
    step = next(k for k in (*STEPS, 1) if width % k == 0)
    symbol = symbols(data[pick], own, step)
    suffixes = np.append(0, np.cumsum(length[distinct] + 1))
    cut = np.append(np.flatnonzero(np.append(True, np.diff(own[1:] // SHARD_BYTES) != 0)), len(distinct))
    members = [distinct[a:b] for a, b in zip(cut[:-1], cut[1:])]
    shards = [Shard(symbol[suffixes[a] : suffixes[b]], length[distinct[a:b]], step) for a, b in zip(cut[:-1], cut[1:])]
    shard, string, offset, group = intervals(shards, width // step)
    base = np.append(0, np.cumsum([len(m) for m in members]))[:-1]
    context = np.concatenate(members)[base[shard] + string]
    window = length[context] - offset >= width
    context, offset, group = context[window], offset[window], group[window]
    by_rank = np.empty(len(rank), np.int64)
    by_rank[rank] = np.arange(len(rank))
    context, offset = _lowest(group, rank[context], offset)
    later[window_at[by_rank[context]] + offset] = False
    return np.split(later, np.cumsum([int((n - width + 1).sum()) for n in lengths])[:-1])


def _answered(docs: DataFrame, id_col: str, text_col: str, width: int, hot: int) -> tuple[DataFrame, int]:
    packed = pack(docs, id_col, text_col)
    bits = bucket_bits(packed)
    fine = bits + FINER

    def is_shared(group: np.ndarray, facts: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """0: occurs once, 1: twice or more, 2: with more contexts than ``hot``."""
        total = np.bincount(group, weights=facts)[group]
        return (total > 1).astype(np.uint64) + (total > hot).astype(np.uint64)

    def ask_anchors(batches: Batches) -> Batches:
        for chunk, pieces, _ in chunks_of(batches):
            yield from requests(chunk, 1, *_Contexts(pieces, width).counts(), bits)

    def send(batches: Batches) -> Batches:
        for chunk, pieces, replies in chunks_of(batches):
            own = _Contexts(pieces, width)
            firsts, bucket = own.sent(own.sort(replies)[0], fine)
            cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1], cut[1:]):
                data, lengths = own.bytes_of(firsts[a:b])
                yield record(
                    {
                        "bucket": [int(bucket[a])], "chunk": [chunk], "orders": [planes(own.order[own.row[firsts[a:b]]])],
                        "lengths": [planes(lengths)], "body": [pa.compress(data.tobytes(), "zstd", asbytes=True)], "size": [len(data)],
                    }
                )

    def ask_hot(batches: Batches) -> Batches:
        for chunk, pieces, replies in chunks_of(batches):
            own = _Contexts(pieces, width)
            _, start, key, rank = own.hot_windows(own.sort(replies)[2])
            first = _first_of_each(key, rank, start)
            by_rank = np.sort(own.order, kind="stable")
            yield from requests(chunk, 3, key[first], by_rank[rank[first]], bits)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bodies = [np.frombuffer(pa.decompress(b, n, "zstd", asbytes=True), np.uint8) for b, n in zip(rows["body"], rows["size"])]
        lengths = [from_planes(n).astype(np.int64) for n in rows["lengths"]]
        later = later_windows(bodies, lengths, [from_planes(o) for o in rows["orders"]], rows["chunk"].to_numpy(), width)
        return pd.DataFrame({"chunk": rows["chunk"], "kind": 2, "bucket": key[0], "reply": [_bits(f) for f in later]})

    shared = written(answer(mapped(packed, ask_anchors, REQUESTS), is_shared, _count_hot))
    known = with_replies(packed, shared)
    told = mapped(known, send, CONTEXTS).groupBy("bucket").applyInPandas(compare, "chunk long, kind int, bucket long, reply binary")
    replies = shared.union(written(told))
    counts = shared.where(F.col("chunk") == SUMMARY).select("reply").toLocalIterator()
    if any(from_planes(r[0])[0] for r in counts):
        replies = replies.union(written(answer(mapped(known, ask_hot, REQUESTS), is_first)))
    return with_replies(packed, replies), fine


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, hot: int = HOT) -> DataFrame:
    """Per document: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (remaining bytes).

    A byte is removed if it lies in a string of ``width`` bytes that also starts earlier: in a document with a smaller id (an
    integer), or earlier in the same one; strings are judged on the input and do not cross documents.  Null and
    empty texts have no bytes.  Null ids come last; rows with equal ids are different documents in the order in
    which they are stored.  An empty table gives an empty result; other columns are ignored.
    """
    return _results(docs, id_col, text_col, width, hot, "kept binary")


def suffix_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, hot: int = HOT) -> DataFrame:
    """As ``suffix_dedup``, with ``kept_sha256`` in place of the remaining bytes."""
    return _results(docs, id_col, text_col, width, hot, "kept_sha256 string")


def _results(docs: DataFrame, id_col: str, text_col: str, width: int, hot: int, last: str) -> DataFrame:
    if width < 2 * GRAM:
        raise ValueError(f"windows of {2 * GRAM} bytes or more")
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    chunks, bits = _answered(docs, id_col, text_col, width, hot)
    name, digest = last.split()[0], last.startswith("kept_sha256")

    def run(batches: Batches) -> Batches:
        for _, pieces, replies in chunks_of(batches):
            own = _Contexts(pieces, width)
            for piece, (data, offsets), gone in zip(pieces, own.texts, own.removed(replies, bits)):
                kept_at = np.append(0, np.cumsum(~gone))[offsets]
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                starts = offsets[:-1][offsets[:-1] < len(data)]
                head[starts] = gone[starts]
                spans = np.append(0, np.cumsum(head))[offsets]
                kept = data[~gone].tobytes()
                parts = [kept[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
                yield record(
                    {
                        "id": piece.column("id"),
                        "n_bytes": np.diff(offsets),
                        "n_removed": np.diff(offsets) - np.diff(kept_at),
                        "n_spans": np.diff(spans),
                        name: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()) if digest else pa.array(parts, pa.binary()),
                    }
                )

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, {last}"
    return mapped(chunks, run, schema).withColumnRenamed("id", id_col)
