"""Chunks of whole texts as rows, and exchanges of hash keys between chunks and buckets.

``pack`` writes the texts once as rows of about ``chunk_bytes`` (an Arrow stream, compressed).  A chunk then
asks for facts on the distinct keys that occur in it (``requests``: sorted 64-bit hashes, cut by their
leading bits into buckets); a bucket sees every chunk's keys of its range once and answers each chunk (``answer``);
``with_replies`` brings the answers back.  However often a key occurs, a chunk sends it once, so a frequent key cannot
overload its bucket, and texts are never grouped by key.  A chunk holds at least one whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardsift.llm.frames import Batches, mapped, record, texts, written
from wardsift.llm.text_arrays import flat, pieces

CHUNK_BYTES = 1 << 22
BUCKET_BYTES = 1 << 22
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(docs: DataFrame, id_col: str, text_col: str, *more: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(``chunk``, ``size`` in bytes of text, ``body``), written once so that chunk numbers stay as they are."""

    def run(batches: Batches) -> Batches:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for piece in pieces(batches, "text"):
            own = len(flat(piece.column("text"))[0])
            if held and size + own > chunk_bytes:
                yield record({"chunk": [number], "size": [size], "body": [_body(held)]})
                number, held, size = number + 1, [], 0
            held.append(_copy(piece))
            size += own
        if held:
            yield record({"chunk": [number], "size": [size], "body": [_body(held)]})

    narrow = texts(docs, id_col, text_col) if not more else docs.select(
        F.col(f"`{id_col}`").alias("id"), *more, F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")
    )
    return written(mapped(narrow, run, "chunk long, size long, body binary"))


def _body(held: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=_ZSTD) as out:
        for batch in held:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _copy(piece: pa.RecordBatch) -> pa.RecordBatch:
    return piece.take(pa.array(np.arange(piece.num_rows)))


def unpack(body: pa.Scalar | bytes) -> list[pa.RecordBatch]:
    """The pieces of a chunk, in order."""
    return list(pa.ipc.open_stream(body.as_buffer() if isinstance(body, pa.Scalar) else body))


def bucket_bits(packed: DataFrame) -> int:
    """Leading bits that number the buckets; their number follows the text, so a bucket's share does not grow."""
    total = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(0, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))


def planes(values: np.ndarray) -> bytes:
    """Values as compressed planes of bytes: the high planes of sorted or small values take almost no room."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


REQUESTS = "bucket long, kind int, chunk long, keys binary, facts binary"


def requests(chunk: int, kind: int, keys: np.ndarray, facts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows for sorted distinct ``keys`` with one or more 64-bit facts each (``facts`` by key), cut by bucket."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.append(np.append(0, np.flatnonzero(np.diff(bucket)) + 1), len(keys))
    for at in range(0, len(cut) - 1, 256):
        spans = list(zip(cut[at : at + 256], cut[at + 1 : at + 257]))
        yield record(
            {
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                "kind": pa.array([kind] * len(spans), pa.int32()),
                "chunk": pa.array([chunk] * len(spans), pa.int64()),
                "keys": pa.array([planes(keys[a:b]) for a, b in spans], pa.binary()),
                "facts": pa.array([planes(facts[a:b].T) for a, b in spans], pa.binary()),
            }
        )


#: Chunk number of the rows that sum up a bucket.
SUMMARY = -1


def answer(
    asked: DataFrame,
    reply: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    fields: int = 1,
) -> DataFrame:
    """(``chunk``, ``kind``, ``bucket``, ``reply``) for request rows.

    ``reply(group, facts, chunk)`` sees all keys of a bucket: ``group`` numbers the distinct keys, ``chunk`` tells who
    asks.  It returns one 64-bit value per requested key, or ``fields`` of them if that many facts were sent (rows of a
    matrix; see ``replies_of``).  ``summary(keys, replies)`` adds a row of chunk ``SUMMARY`` with
    its values over the distinct keys of the bucket.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [from_planes(k) for k in rows["keys"]]
        facts = np.concatenate([_fields(from_planes(f), fields) for f in rows["facts"]])
        sizes = [len(k) for k in keys]
        distinct, at, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        replies = reply(group, facts, np.repeat(rows["chunk"].to_numpy(), sizes))
        out = [(c, planes(p.T)) for c, p in zip(rows["chunk"], np.split(replies, np.cumsum(sizes)[:-1]))]
        if summary:
            out.append((SUMMARY, planes(summary(distinct, replies[at]))))
        return pd.DataFrame({"chunk": [c for c, _ in out], "kind": key[1], "bucket": key[0], "reply": [r for _, r in out]})

    return asked.groupBy("bucket", "kind").applyInPandas(run, "chunk long, kind int, bucket long, reply binary")


def with_replies(packed: DataFrame, replies: DataFrame) -> DataFrame:
    """Chunks with ``replies``: a list of (kind, bucket, reply), no longer than the chunk's own distinct keys."""
    own = replies.where(F.col("chunk") != SUMMARY).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "reply"))).alias("replies"))
    return packed.join(own, "chunk", "left")


def _fields(values: np.ndarray, fields: int) -> np.ndarray:
    return values if fields == 1 else values.reshape(fields, -1).T


def replies_of(cell: pa.Scalar, kind: int, fields: int = 1) -> np.ndarray:
    """The answers of one kind in the order of the sorted keys that were asked."""
    parts = [_fields(from_planes(r["reply"]), fields) for r in (cell.as_py() or []) if r["kind"] == kind]
    return np.concatenate(parts) if parts else _fields(np.zeros(0, np.uint64), fields)


def chunks_of(batches: Batches) -> Iterator[tuple[int, list[pa.RecordBatch], pa.Scalar | None]]:
    for batch in batches:
        has = "replies" in batch.schema.names
        for i in range(batch.num_rows):
            yield batch.column("chunk")[i].as_py(), unpack(batch.column("body")[i]), batch.column("replies")[i] if has else None


def is_repeated(group: np.ndarray, facts: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """1 where a key occurs twice or more in all; facts are the counts in each chunk."""
    return (np.bincount(group, weights=facts) > 1)[group].astype(np.uint64)


def is_first(group: np.ndarray, facts: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """1 for the chunk with the smallest fact of a key; chunk numbers break ties."""
    order = np.lexsort((chunk, facts, group))
    head = order[np.append(True, np.diff(group[order]) > 0)] if len(order) else order
    first = np.zeros(len(group), np.uint64)
    first[head] = 1
    return first
