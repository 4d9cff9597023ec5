"""Counting quotient filters over packed word-id n-grams.

An n-gram of up to three ids of ``bits`` bits is permuted invertibly (a Feistel network over its three lanes), so that keys
spread evenly whatever the text.  The leading bits of a permuted key are its quotient, the others its full remainder;
nothing is cut off, so a filter counts without loss and its n-grams can be read back.  A filter is stored sorted: run lengths
per quotient, remainders in that order, and counters, each as byte planes of the width they need.  Sorted filters of
different shards merge into one.  A slice of a filter holds the keys with a common prefix, which it leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from wardsift.llm.text_arrays import mix

ROUNDS = 6
_ROUND = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(ROUNDS)], np.uint64)


class Filter(NamedTuple):
    """Sorted permuted keys (high lane, both low lanes) with their counts."""

    high: np.ndarray
    low: np.ndarray
    count: np.ndarray


def _scramble(left: np.ndarray, right: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix((left << np.uint64(32) | right) + _ROUND[k]) & np.uint64((1 << bits) - 1)


def permute(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) permuted keys of a (3, n) matrix of ids below ``2 ** bits`` (32 bits at most)."""
    a, b, c = grams.astype(np.uint64)
    for k in range(ROUNDS):
        a, b, c = b, c, a ^ _scramble(b, c, k, bits)
    return a, b << np.uint64(bits) | c


def restore(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """The (3, n) ids of permuted keys."""
    a, b, c = high, low >> np.uint64(bits), low & np.uint64((1 << bits) - 1)
    for k in range(ROUNDS - 1, -1, -1):
        a, b, c = c ^ _scramble(a, b, k, bits), a, b
    return np.stack([a, b, c]).astype(np.int64)


def count(high: np.ndarray, low: np.ndarray, counts: np.ndarray, bits: int) -> Filter:
    """A filter of keys in any order, repeated keys summed.  The stable sort takes sorted parts as runs and merges them."""
    if not len(high):
        return Filter(high, low, counts)
    if 3 * bits <= 64:
        order = np.argsort(high << np.uint64(2 * bits) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    high, low = high[order], low[order]
    at = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    return Filter(high[at], low[at], np.add.reduceat(counts[order], at))


def merge(filters: list[Filter], bits: int) -> Filter:
    return count(*(np.concatenate(parts) for parts in zip(*filters)), bits)


def _narrow(values: np.ndarray) -> bytes:
    """Values as compressed byte planes, as many as the greatest needs; the number of values is known elsewhere."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if width else b"")


def _widened(data: bytes, n: int) -> np.ndarray:
    out, width = np.zeros((n, 8), np.uint8), data[0]
    if width:
        out[:, :width] = np.frombuffer(pa.decompress(data[1:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def encode(part: Filter, bits: int, prefix_bits: int) -> bytes:
    """A slice whose keys share their first ``prefix_bits`` (of the high lane)."""
    n = len(part.high)
    free = bits - prefix_bits
    quotient_bits = min(free, max(0, n.bit_length() - 1))
    rest = part.high & np.uint64((1 << free) - 1)
    runs = np.bincount((rest >> np.uint64(free - quotient_bits)).astype(np.int64), minlength=1 << quotient_bits)
    remainder = rest & np.uint64((1 << (free - quotient_bits)) - 1)
    cells = [_narrow(v) for v in (runs, remainder, part.low, part.count)]
    head = np.array([n, quotient_bits, *map(len, cells)], np.int64).tobytes()
    return head + b"".join(cells)


def decode(data: bytes, prefix: int, bits: int, prefix_bits: int) -> Filter:
    n, quotient_bits, *sizes = np.frombuffer(data, np.int64, 6).tolist()
    cut = np.cumsum([48, *sizes])
    cells = [data[a:b] for a, b in zip(cut[:-1], cut[1:])]
    free = bits - prefix_bits
    quotient = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), _widened(cells[0], 1 << quotient_bits).astype(np.int64))
    high = np.uint64(prefix << free) | quotient << np.uint64(free - quotient_bits) | _widened(cells[1], n)
    return Filter(high, _widened(cells[2], n), _widened(cells[3], n))


def slices(whole: Filter, bits: int, prefix_bits: int) -> Iterator[tuple[int, bytes]]:
    """(prefix, slice) of a filter cut by its first ``prefix_bits``."""
    prefix = (whole.high >> np.uint64(bits - prefix_bits)).astype(np.int64)
    cut = np.append(np.append(0, np.flatnonzero(np.diff(prefix)) + 1), len(prefix)) if len(prefix) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(prefix[a]), encode(Filter(*(v[a:b] for v in whole)), bits, prefix_bits)
