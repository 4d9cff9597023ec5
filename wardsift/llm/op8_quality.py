"""Quality rules from suffix-array repetition inside each document.

A word-level suffix array (prefix doubling over the documents of a piece, document first) gives the
longest common prefix of neighbours.  Every suffix then begins a repeated substring as long as the
deepest interval that holds it; the union of these spans, from ``min_repeat`` words up, is the
repeated part of the document.  Two limits judge it: the covered share of words and the longest repeat.
Documents are independent, so there is no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from wardsift.llm.frames import Batches, mapped, record, rows_where, texts
from wardsift.llm.text_arrays import flat, pieces, row_of, shingles, word_hashes, words, IS_SPACE

#: The symbol characters that are counted.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

SCHEMA = (
    "id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_repeat: int = 10,
    max_covered: float = 0.30,
    max_repeat: int = 100,
    max_symbols: float | None = None,
) -> DataFrame:
    """Counts and verdict per document (column ``id_col`` and those of ``SCHEMA``).

    A document is kept if the base rules hold (50 words or more, at most half of the words in repeated
    3-word windows), repeats of ``min_repeat`` words or more cover at most ``max_covered`` of its
    words, and no repeat has more than ``max_repeat`` words.  Coverage ends at 30 %, well below the half at which the base
    rule ends: a passage that a document has twice covers double its length, so a seventh of a text may come again.
    Symbols are counted and do not decide ``kept``; with ``max_symbols``, column ``symbols_failed`` tells the documents that have
    more symbols per word.  Null and empty texts have no words and
    fail.  Null ids and repeated rows are judged row by row; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    schema = SCHEMA.format(id=kind) + ("" if max_symbols is None else ", symbols_failed boolean")

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            judged = _judge(*flat(piece.column("text")), min_repeat, max_covered, max_repeat)
            if max_symbols is not None:
                judged["symbols_failed"] = judged["n_symbols"] > max_symbols * judged["n_words"]
            yield record({"id": piece.column("id")} | judged)

    return mapped(texts(docs, id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def drop_rejected(
    docs: DataFrame,
    text_col: str = "text",
    min_repeat: int = 10,
    max_covered: float = 0.30,
    max_repeat: int = 100,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    return rows_where(docs, text_col, lambda c: _judge(*flat(c), min_repeat, max_covered, max_repeat)["kept"])


def _judge(data: np.ndarray, offsets: np.ndarray, min_repeat: int, max_covered: float, max_repeat: int) -> dict:
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    row = row_of(first)
    repeat_words = _row_sums(_covered_by_repeats(hashes, first, 3), first)
    span = repeat_spans(hashes, first, min_repeat)
    covered = _row_sums(_union(span), first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, span)
    n_symbols = _row_sums(_IS_SYMBOL[data], offsets)
    base_failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": _row_sums(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": n_symbols,
        "n_dup_lines": _duplicate_lines(data, offsets, starts),
        "n_repeat_words": repeat_words,
        "n_covered_words": covered,
        "longest_repeat": longest,
        "base_failed": base_failed,
        "kept": ~base_failed & (covered <= max_covered * n_words) & (longest <= max_repeat),
    }


def _row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _twins(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: this key occurs again; this key occurred at a smaller index."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    later[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes made distinct between rows."""
    return hashes ^ ((row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _covered_by_repeats(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Per word: does it lie in an ``n``-word window that its document has twice or more?"""
    windows, offsets = shingles(hashes, first, n)
    again, _ = _twins(_keyed(windows, row_of(offsets)))
    at = np.arange(len(windows)) - np.repeat(offsets[:-1], np.diff(offsets)) + np.repeat(first[:-1], np.diff(offsets))
    span = np.zeros(len(hashes), np.int64)
    span[at[again]] = n
    return _union(span)


def _union(span: np.ndarray) -> np.ndarray:
    """Per position: is it covered by a span (start, length) that begins here or before?"""
    at = np.arange(len(span))
    return np.maximum.accumulate(at + span) > at if len(span) else np.zeros(0, bool)


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.minimum(
        np.append(breaks, len(data))[np.searchsorted(breaks, begin)], offsets[np.searchsorted(offsets, begin, "right")]
    )
    has_word = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end = begin[has_word], end[has_word]
    row = np.searchsorted(offsets, begin, "right") - 1
    _, later = _twins(_keyed(word_hashes(data, begin, end), row))
    return np.bincount(row[later], minlength=len(offsets) - 1).astype(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_ranks(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, document first.

    Word ``len`` stands for the end of a document, so ranks compare inside one document only.  Rounds
    refine the groups that are still shared and end when all ranks are distinct.
    """
    n = len(hashes)
    stop = np.repeat(first[1:], np.diff(first))
    levels = [_dense(_keyed(hashes, row_of(first)))]
    step = 1
    while True:
        rank = levels[-1]
        shared = np.bincount(rank, minlength=n)[rank] > 1
        if not shared.any() or step >= n:
            return levels
        at = np.flatnonzero(shared)
        next_at = at + step
        follow = np.where(next_at < stop[at], rank[np.minimum(next_at, n - 1)] + 1, 0)
        sizes = np.bincount(rank)  # a group of s suffixes owns s ranks, so that parts of it fit in
        place = np.cumsum(sizes) - sizes
        refined = place[rank]
        order = np.lexsort((follow, rank[at]))
        r, f = rank[at][order], follow[order]
        new_group = np.append(True, r[1:] != r[:-1])
        new_value = new_group | np.append(True, f[1:] != f[:-1])
        index = np.arange(len(order))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        value_start = np.maximum.accumulate(np.where(new_value, index, 0))
        refined[at[order]] += value_start - group_start
        levels.append(refined)
        step *= 2


def repeat_spans(hashes: np.ndarray, first: np.ndarray, min_repeat: int) -> np.ndarray:
    """Per suffix: length of the longest repeat of its document that begins there, 0 if below ``min_repeat``."""
    n = len(hashes)
    span = np.zeros(n, np.int64)
    if not n:
        return span
    levels = suffix_ranks(hashes, first)
    stop = np.repeat(first[1:], np.diff(first))
    depth = min(int(np.log2(min_repeat)), len(levels) - 1)
    shared = np.bincount(levels[depth], minlength=n)[levels[depth]] > 1
    at = np.flatnonzero(shared)
    if not len(at):
        return span
    order = at[np.argsort(levels[-1][at], kind="stable")]
    left, right = order[:-1], order[1:]
    joined = levels[depth][left] == levels[depth][right]
    left, right = left[joined], right[joined]
    common = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        while True:
            a, b = left + common, right + common
            open_ = (a + (1 << level) <= stop[left]) & (b + (1 << level) <= stop[right])
            same = open_ & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
            common[same] += 1 << level
            if level < len(levels) - 1 or not same.any():
                break
    long = common >= min_repeat
    np.maximum.at(span, left[long], common[long])
    np.maximum.at(span, right[long], common[long])
    return span
