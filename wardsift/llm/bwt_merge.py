"""Burrows-Wheeler transforms of string collections and their merge by iterative interleave refinement.

A shard is a collection of byte strings; its transform lists, in suffix order, the symbol before each suffix.  Merging
keeps, per slot of the common order, only the shard it comes from.  One refinement reads the slots in order, takes the
next symbol of each slot's transform, and places the slot's shard into the bucket of that symbol: an order by h
symbols becomes one by h + 1 without comparing or sorting a suffix.  A border between two slots that first
appears in round h says that the suffixes beside it share h - 1 symbols.

A symbol stands for ``step`` bytes (their rank among all of the collection), and the symbol before a suffix are the
``step`` bytes before it, so a refinement deepens the order by ``step`` bytes.  Suffixes shorter than ``step`` are
end marks: they differ from each other and come first, string by string.
"""

from __future__ import annotations

import numpy as np


def symbols(data: np.ndarray, offsets: np.ndarray, step: int) -> np.ndarray:
    """The symbol at every suffix (string by string, one suffix more than bytes), 0 for end marks."""
    strings = len(offsets) - 1
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(strings), lengths)
    whole = np.arange(len(data)) + step <= np.repeat(offsets[1:], lengths)
    rank = _gram_ranks(data, step)[whole]
    rank = rank + 1
    out = np.zeros(len(data) + strings, np.uint16 if len(rank) == 0 or rank.max() < 1 << 16 else np.uint32)
    out[place[whole]] = rank
    return out


def ordered(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (below ``limit``) in order, and where they stood, equal ones by place.

    A key and its place are sorted as one number, which is several times faster than ``argsort``, where they fit into 63 bits.
    """
    bits = len(keys).bit_length()
    if limit << bits > 1 << 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys.astype(np.int64)
    both <<= bits
    both |= np.arange(len(keys))
    both.sort()
    order = both & (1 << bits) - 1
    both >>= bits
    return both, order


def _dense(keys: np.ndarray, limit: int) -> np.ndarray:
    keys, order = ordered(keys, limit)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(False, keys[1:] != keys[:-1])[: len(keys)])
    return out


def _gram_ranks(data: np.ndarray, step: int) -> np.ndarray:
    """Dense rank of the ``step`` bytes from every position on (zeros after the end); long ones from ranks of their halves."""
    at = np.arange(len(data))
    last = max(len(data) - 1, 0)
    if step <= 7:
        gram = np.zeros(len(data), np.uint64)
        for j in range(step):
            gram = gram << np.uint64(8) | data[np.minimum(at + j, last)].astype(np.uint64)
        return _dense(gram, 1 << 8 * step)
    half = (step + 1) // 2
    rank = _gram_ranks(data, half)
    ranks = int(rank.max(initial=-1)) + 1
    pair = rank * ranks + rank[np.minimum(at + step - half, last)]
    return _dense(pair, ranks * ranks)


class Shard:
    """Suffixes in order (``string``, ``offset``), the symbol before each (0: none) and the number of end marks."""

    def __init__(self, symbol: np.ndarray, lengths: np.ndarray, step: int):
        string = np.repeat(np.arange(len(lengths)), lengths + 1)
        start = np.cumsum(lengths + 1) - (lengths + 1)
        order = suffix_order(symbol, step)
        self.string, self.offset = string[order], order - start[string[order]]
        self.transform = np.where(self.offset < step, 0, symbol[np.maximum(order - step, 0)]).astype(symbol.dtype)
        self.marks = int(np.minimum(lengths + 1, step).sum())


def suffix_order(symbol: np.ndarray, step: int) -> np.ndarray:
    """Suffixes in order by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbol)
    at = np.arange(n)
    sorted_, order = stable_order(symbol)
    new = np.append(True, (sorted_[1:] != sorted_[:-1]) | (sorted_[1:] == 0))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    depth = step
    size = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        key = rank[tied] * np.int64(n) + rank[tied + depth]
        sorted_, local = ordered(key, n * n)
        r = rank[tied[local]]
        group = np.append(True, r[1:] != r[:-1])
        value = np.append(True, sorted_[1:] != sorted_[:-1])
        index = at[: len(local)]
        first = np.maximum.accumulate(np.where(group, index, 0))
        placed = r + np.maximum.accumulate(np.where(value, index, 0)) - first
        rank[tied[local]] = placed
        again = ~value
        again[:-1] |= ~value[1:]
        tied = np.sort(tied[local[again]])
        depth *= 2
    order = np.empty(n, np.int64)
    order[rank] = at
    return order


def stable_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small unsigned numbers in order, and their stable order: one radix pass for 16 bits, else as one number with their places."""
    if values.dtype.itemsize <= 2:
        order = np.argsort(values, kind="stable")
        return values[order], order
    return ordered(values, 1 << 32)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Source shard of every slot, and the symbols it shares with the slot before (at most ``rounds``, which also stands for more)."""
    sizes = [len(s.transform) for s in shards]
    marks = sum(s.marks for s in shards)
    n = sum(sizes)
    transforms = np.concatenate([s.transform for s in shards])
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    source = np.repeat(np.arange(len(shards)), sizes).astype(kind)
    end_marks = np.repeat(np.arange(len(shards)), [s.marks for s in shards]).astype(kind)
    border = np.zeros(n, bool)
    border[:1] = True
    common = np.full(n, rounds, np.int32)
    common[:1] = 0
    symbol = np.empty(n, transforms.dtype)
    for round_ in range(1, rounds + 1):
        symbol[np.argsort(source, kind="stable")] = transforms
        moved, place = stable_order(symbol)
        block = np.cumsum(border, dtype=np.int32)[place]
        now = np.empty(n, bool)
        now[:1] = True
        now[1:] = (moved[1:] != moved[:-1]) | (block[1:] != block[:-1])
        source = source[place]
        source[:marks], now[: marks + 1] = end_marks, True
        common[now & ~border] = round_ - 1
        border |= now
    return source, common


def intervals(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, string, offset, interval) of all suffixes; equal intervals share ``rounds`` symbols or more."""
    source, common = merge(shards, rounds)
    group = np.cumsum(common < rounds)
    slots = np.argsort(source, kind="stable")
    return (
        source[slots].astype(np.int64),
        np.concatenate([s.string for s in shards]),
        np.concatenate([s.offset for s in shards]),
        group[slots],
    )
