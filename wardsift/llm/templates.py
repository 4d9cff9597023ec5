"""Containment of short templates in long texts: size-partitioned MinHash, verified exactly.

Templates (benchmark items, license texts) are partitioned by the power of two that holds their number
of distinct shingles.  For a partition of up to u shingles every text is cut into blocks of u shingles,
and the two, adjacent blocks form overlapping windows of 2u shingles at stride u: each run of u shingles
lies whole in one window.  MinHash values of a window are minima of block minima, so all partitions cost
one pass.  A window that agrees with a template in any one value (bands of one row) retrieves it, and the
exact set of shingles decides.

A text that has a share t of a template's shingles inside one window of 2u, u <= 2 * size, has a
similarity of at least t / (5 - t) ~ 0.19 for t = 0.8 with that window; with 64 values the chance to miss it is
(1 - 0.19) ** 64 < 2e-6, and less than 1e-12 for a contiguous copy.  """

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wardsift.llm.frames import Batches, mapped, record, texts, written
from wardsift.llm.text_arrays import LOWER, flat, shingles, word_hashes, words

VALUES = 64
_SALTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
FILTER_BITS = 16


def text_shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles (A-Z lower-cased) of every row, and the row offsets among them."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return shingles(word_hashes(data, starts, ends), first, width)


def value(short: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of 32-bit shingle hashes; clashes only cost a verification."""
    return short * _SALTS[k]


def short_hash(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32)


class TemplateIndex:
    """A block of templates with a bounded number of shingles, ready to be broadcast.

    ``ids`` and ``sets`` are parallel; ``sets`` hold sorted distinct shingle hashes.  Templates without
    shingles are left out: they are contained in nothing.
    """

    def __init__(self, ids: list, sets: list[np.ndarray]):
        kept = [(i, s) for i, s in zip(ids, sets) if len(s)]
        self.ids = [i for i, _ in kept]
        self.sets = [s for _, s in kept]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        for at, s in enumerate(self.sets):
            by_class.setdefault(max(0, int(len(s) - 1).bit_length()), []).append(at)
        for level, members in by_class.items():
            tables = []
            for k in range(VALUES):
                low = np.array([value(short_hash(self.sets[m]), k).min() for m in members], np.uint32)
                order = np.argsort(low, kind="stable")
                tables.append((low[order], np.array(members)[order]))
            self.classes[level] = tables
        self.filters = {level: [_bitmap(t[0]) for t in tables] for level, tables in self.classes.items()}

    def find(self, hashes: np.ndarray, offsets: np.ndarray, threshold: float):
        """(row, template number, share) of all rows and templates with share >= threshold."""
        if not self.sets or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found: list[np.ndarray] = []
        cuts = self._cuts(offsets)
        short = short_hash(hashes)
        for k in range(VALUES):
            low = value(short, k)
            for level, row, start in cuts:
                low = np.minimum.reduceat(low, start)
                # A window is a block and the next one of its row; the last block stands for its own.
                pair = np.minimum(low[:-1], low[1:])
                same = row[:-1] == row[1:]
                for window, of in ((pair[same], row[:-1][same]), (low, row)):
                    hit = self.filters[level][k][window >> np.uint32(32 - FILTER_BITS)]
                    if hit.any():
                        found.append(self._retrieve(level, k, window[hit], of[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        pairs = np.unique(np.concatenate(found))
        row, template = pairs // len(self.sets), pairs % len(self.sets)
        share = np.zeros(len(pairs))
        at = 0
        while at < len(pairs):
            to = int(np.searchsorted(row, row[at], "right"))
            own = np.unique(hashes[offsets[row[at]] : offsets[row[at] + 1]])
            for j in range(at, to):
                wanted = self.sets[template[j]]
                place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                share[j] = np.count_nonzero(own[place] == wanted) / len(wanted)
            at = to
        keep = share >= threshold
        return row[keep], template[keep], share[keep]

    def _cuts(self, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Per partition: row of each block, and where it starts among the blocks of the partition before."""
        out, below, fine = [], offsets, 0
        for level in sorted(self.classes):
            counts = np.diff(below)
            blocks = (counts + (1 << level - fine) - 1) >> level - fine
            own = np.zeros(len(below), np.int64)
            np.cumsum(blocks, out=own[1:])
            row = np.repeat(np.arange(len(counts)), blocks)
            start = below[:-1][row] + ((np.arange(len(row)) - own[:-1][row]) << level - fine)
            out.append((level, row, start))
            below, fine = own, level
        return out

    def _retrieve(self, level: int, k: int, window: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Pairs row * number of templates + template whose k-th values agree."""
        low, members = self.classes[level][k]
        left = np.searchsorted(low, window, "left")
        n = np.searchsorted(low, window, "right") - left
        at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(of, n) * len(self.sets) + members[at]


def _bitmap(low: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[low >> np.uint32(32 - FILTER_BITS)] = True
    return flags


#: Templates are compared in blocks with about this many shingles (8 bytes each), whatever their number.
BLOCK_SHINGLES = 1_000_000


def blocks(templates: DataFrame, id_col: str, text_col: str, width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Template ids and shingle sets, a block at a time; every block is a bounded part of the query set."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            hashes, offsets = text_shingles(batch.column("text"), width)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield record({"id": batch.column("id"), "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    kind = templates.select(f"`{id_col}`").schema[0].dataType.simpleString()
    known = written(mapped(texts(templates, id_col, text_col).where("id is not null"), run, f"id {kind}, n long, hashes binary"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = math.ceil(total / BLOCK_SHINGLES)
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r.id, r.hashes))
        yield [r.id for r in rows], [np.frombuffer(r.hashes, np.uint64) for r in rows]
