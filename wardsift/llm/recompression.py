"""Recompression of word sequences: rounds that name runs and pairs the same way wherever they occur.

A round first replaces maximal runs of equal symbols, then pairs: every symbol belongs to the left or the right side
by a bit of its name, and a left symbol followed by a right one becomes a new symbol.  A name is a digest of what it
stands for, so all tasks agree on it without an exchange.  ``need`` tells which words fix a symbol: any other
place with these words, whatever surrounds them, has the same symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wardsift.llm.text_arrays import mix

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass
class Symbols:
    """Names, the words they cover (``start``, ``end``) and the words that fix them (``need_start``, ``need_end``).

    A symbol that depends on a document's border needs a word outside of it, so no window holds it.
    """

    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    need_start: np.ndarray
    need_end: np.ndarray


def symbols(hashes: np.ndarray, row: np.ndarray) -> Symbols:
    at = np.arange(len(hashes))
    return Symbols(hashes, row, at, at + 1, at, at + 1)


def _beside(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Is the next symbol of the same row; first word needed by the one before; last word needed by the one after."""
    joined = s.row[1:] == s.row[:-1]
    before = np.append(s.start[:1] - 1, np.where(joined, s.need_start[:-1], s.start[1:] - 1))
    after = np.append(np.where(joined, s.need_end[1:], s.end[:-1] + 1), s.end[-1:] + 1)
    return joined, before, after


def name_runs(s: Symbols) -> Symbols:
    joined, before, after = _beside(s)
    same = joined & (s.name[1:] == s.name[:-1])
    head = np.flatnonzero(np.append(True, ~same))
    tail = np.append(head[1:], len(s.name)) - 1
    size = tail - head + 1
    name = np.where(size > 1, mix(s.name[head] * _B + size.astype(np.uint64) * _A), s.name[head])
    return Symbols(
        name,
        s.row[head],
        s.start[head],
        s.end[tail],
        np.minimum(before[head], s.need_start[head]),
        np.maximum(after[tail], s.need_end[tail]),
    )


def name_pairs(s: Symbols, turn: int) -> Symbols:
    joined, before, after = _beside(s)
    left = (mix(s.name + np.uint64(turn * int(_B) % 2**64)) & np.uint64(1)).astype(bool)
    paired = np.append(joined & left[:-1] & ~left[1:], False)
    swallowed = np.append(False, paired[:-1])
    need_start = np.where(left | paired, s.need_start, np.minimum(before, s.need_start))
    need_end = np.where(left & ~paired, np.maximum(after, s.need_end), s.need_end)
    name, end = s.name.copy(), s.end.copy()
    at = np.flatnonzero(paired)
    name[at] = mix(s.name[at] * _A + s.name[at + 1] * _B + np.uint64(turn))
    end[at] = s.end[at + 1]
    need_start[at] = s.need_start[at]
    need_end[at] = np.maximum(s.need_end[at], s.need_end[at + 1])
    need_start[at] = np.minimum(need_start[at], s.need_start[at + 1])
    keep = np.flatnonzero(~swallowed)
    return Symbols(name[keep], s.row[keep], s.start[keep], end[keep], need_start[keep], need_end[keep])


def recompress(hashes: np.ndarray, row: np.ndarray, rounds: int) -> list[Symbols]:
    """The symbols after every round."""
    levels = [symbols(hashes, row)]
    for turn in range(rounds if len(hashes) else 0):
        levels.append(name_pairs(name_runs(levels[-1]), turn))
    return levels[1:]
