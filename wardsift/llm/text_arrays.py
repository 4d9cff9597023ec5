"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes and shingles.

Everything works on whole texts; a piece holds whole documents and at most ``max_bytes`` of text,
or one longer document, so a task's memory does not grow with its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The bytes that part words (x20 and x09 to x0D).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES = 1 << 20
SHORT = 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with bounded text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = flat(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and the n + 1 offsets of its rows."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that are no ``gaps``), and the n + 1 offsets of the rows in words."""
    inside = ~gaps[data]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[row_starts] = inside[row_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before_start = row_starts[row_starts > 0] - 1
    last[before_start] = inside[before_start]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """n + 1 prefix values from which ``span_hash`` takes the hash of any span in constant time."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers("up", _BASE, len(codes)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of spans; equal contents have equal hashes wherever they start.

    For spans of fewer than 1,024 symbols; longer regular ones can collide (see ``word_hashes``).
    """
    inverse = powers("down", _BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of all spans of ``width`` symbols, in order."""
    hashes = sums[width:] - sums[: len(sums) - width]
    hashes *= powers("down", _BASE_INVERSE, len(sums))[: len(hashes)]
    return mix(hashes)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTE_CODE[data])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The contents of spans that do not overlap, in order, one after the other."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    held = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digests of words or lines: polynomial for short ones, xxHash for those of more than ``SHORT`` bytes.

    A polynomial modulo 2 ** 64 (``span_hash``) loses bits on long regular strings: two Thue-Morse strings share it for certain from 1,024
    symbols on, while at 32 it still tells by 44 bits.
    """
    out = span_hash(byte_sums(data), starts, ends)
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        whole = memoryview(np.ascontiguousarray(data))
        out[long] = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())], np.uint64)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and the offsets of the rows among them.

    A row with fewer words, but at least one, has one shingle: its whole sequence.
    """
    rows = len(first) - 1
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    total = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n if len(total) else 0):
        total += hashes[j : j + len(total)] * _ORDER[j]
    keep = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(first[:-1], sizes)
    out = np.zeros(offsets[-1], np.uint64)
    short = np.repeat((counts < n) & (counts > 0), sizes)
    out[~short] = total[keep[~short]]
    for row in np.flatnonzero((counts < n) & (counts > 0)):
        part = hashes[first[row] : first[row + 1]]
        out[offsets[row]] = (part * _ORDER[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), offsets


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
