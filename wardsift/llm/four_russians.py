"""Exact integer inner products by the method of the Four Russians.

A candidate vector is kept as bit planes of its two's complement integers: plane ``p`` of a group of eight dimensions is
one byte.  For a block of anchors the sums of all 256 subsets of each group are tabled once; a candidate's score with every
anchor of the block is then read from the tables by its bytes, plane by plane from the highest (which counts negatively)
down, doubling what was read so far (shift-add).
"""

from __future__ import annotations

import numpy as np

GROUP = 8


def pack_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, ``planes``, groups) bytes of an integer matrix whose width is a multiple of eight."""
    out = np.empty((len(values), planes, values.shape[1] // GROUP), np.uint8)
    for p in range(planes):
        out[:, p] = np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpack_planes(packed: np.ndarray) -> np.ndarray:
    """The integers of ``pack_planes``."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    signed = 1 << np.arange(packed.shape[1], dtype=np.int64)
    signed[-1] *= -1
    return np.einsum("npd,p->nd", bits, signed)


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sum of every subset of an anchor's values."""
    columns = anchors.T.astype(dtype).reshape(-1, GROUP, len(anchors))
    table = np.zeros((len(columns), 256, len(anchors)), dtype)
    for bit in range(GROUP):
        table[:, 1 << bit : 2 << bit] = table[:, : 1 << bit] + columns[:, bit : bit + 1]
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(candidates, anchors) inner products, exact as long as they fit the type of ``table``."""
    planes = packed.shape[1]
    total = np.zeros((len(packed), table.shape[2]), table.dtype)
    read = np.empty_like(total)
    for p in range(planes - 1, -1, -1):
        total += total
        for sums, index in zip(table, packed[:, p].T):
            np.take(sums, index, axis=0, out=read, mode="clip")
            total += read
        if p == planes - 1:
            np.negative(total, out=total)
    return total
