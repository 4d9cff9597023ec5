r"""Text expressions.

The JVM's ``\w``, ``\b`` and ``\s`` know ASCII only, so all classes are spelled out with Unicode
properties; a word is a run of letters, numbers and underscores of any script.  ASCII ranges come
first in a class and runs are possessive only to make matching cheaper.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Character classes of the text metrics.
WORD_CHARS = r"a-zA-Z0-9_\p{L}\p{N}"
WORD = rf"[{WORD_CHARS}]++"
SENTENCE_END = r"[.!?]+"
UPPER_CHARS = "A-ZÄÖÜ"
SPACE_CHARS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
ASCII_TOKEN = rf"(?<![{WORD_CHARS}])[a-z]{{2,}}+(?![{WORD_CHARS}])"

# Vocabularies whose occurrences are counted as markers.
NEGATIONS = ("no", "not", "never", "without", "unable")
MODALS = ("must", "should", "cannot", "could", "may", "might", "requires")

METRICS = (
    "n_chars",
    "n_words",
    "n_sentences",
    "n_digits",
    "n_upper",
    "n_punct",
    "digit_ratio",
    "upper_ratio",
    "punct_ratio",
)


def _text(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def _count_chars(text: Column, other_chars: str) -> Column:
    """Number of characters left once every run of ``other_chars`` is removed."""
    return F.coalesce(F.length(F.regexp_replace(text, f"[{other_chars}]+", "")), F.lit(0))


def words(text: Column | str) -> Column:
    """All words of the lowercased text, in order."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(WORD), F.lit(0))


def word_count(text: Column | str) -> Column:
    return _count_matches(_text(text), WORD)


def tokens(text: Column | str) -> Column:
    """Whole words of two or more ASCII letters, lowercased; an empty array for null."""
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(ASCII_TOKEN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def vocabulary_count(token_array: Column | str, vocabulary: Iterable[str]) -> Column:
    """How many tokens of the array belong to ``vocabulary``, repeats included."""
    known = F.array(*[F.lit(w) for w in sorted(set(vocabulary))])
    return F.size(F.filter(_text(token_array), lambda t: F.array_contains(known, t)))


def has_digit(text: Column | str) -> Column:
    return F.coalesce(F.regexp_like(_text(text), F.lit(r"\p{Nd}")), F.lit(False))


def text_metrics(text: Column | str) -> dict[str, Column]:
    """Counts of one text by name; the ratios are added by :func:`with_text_metrics`."""
    t = _text(text)
    return {
        "n_chars": F.coalesce(F.length(t), F.lit(0)),
        "n_words": word_count(t),
        "n_sentences": _count_matches(t, SENTENCE_END),
        "n_digits": _count_matches(t, r"\p{Nd}"),
        "n_upper": _count_chars(t, f"^{UPPER_CHARS}"),
        "n_punct": _count_chars(t, WORD_CHARS + SPACE_CHARS),
    }


def char_ratio(count: str, n_chars: str = "n_chars") -> Column:
    return F.when(F.col(n_chars) > 0, F.col(count) / F.col(n_chars)).otherwise(F.lit(0.0))


def text_hash(text: Column | str) -> Column:
    """SHA-256 of the lowercased text without surrounding white space."""
    return F.sha2(F.regexp_replace(F.lower(_text(text)), rf"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+$", ""), 256)
