"""Language of web pages by Bayesian evidence fusion.

Evidence per page: text likelihoods (multinomial model of byte trigrams, trained on all labelled documents), the
language that the markup declares, and a prior of its host.  The prior is smoothed over a hierarchy: host, address
suffix, all pages; each level is the sum of the text posteriors of its pages (less the page's own) plus
``strength`` pseudo pages of the level above.  How far a declaration can be trusted is estimated the same way,
from the table of declared language by text posterior.  All sums are grouped aggregations with map-side partial sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardsift.llm.frames import Batches, mapped, record, texts, written
from wardsift.llm.text_arrays import LOWER, flat, pieces, row_of

FEATURES = 1 << 16
MOST_LANGUAGES = 256
#: More trigrams than this add no certainty: the mean over the whole text counts as so many.
EVIDENCE = 100.0

#: Markup.  What is never closed runs to the end of the page, so that no character is looked at again for every opening before it.
SKIPPED = r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)"
DECLARED = r"""(?is)<html\b[^<>]*?\slang\s*=\s*["']?\s*([a-z]{2,3})"""
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every byte trigram inside a row; A-Z lower-cased, line breaks and tabs as spaces."""
    low = LOWER[data].astype(np.uint32)
    low[low < 33] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    row = row_of(offsets)
    inside = row[:-2] == row[2:]
    return ((code[inside] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), row[:-2][inside]


class TextModel:
    """Log probabilities of features per language; ``languages`` is sorted."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihood per row and language, tempered so that long texts do not drown other evidence."""
        feature, row = _trigrams(data, offsets)
        rows = len(offsets) - 1
        n = np.bincount(row, minlength=rows)
        out = np.stack([np.bincount(row, weights=p[feature], minlength=rows) for p in self.log_p], axis=1)
        return out * (EVIDENCE / (EVIDENCE + n))[:, None]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """Counts over all rows with a language; the model has at most ``MOST_LANGUAGES`` x ``FEATURES`` numbers."""
    labelled = texts(docs.where(F.col(f"`{lang_col}`").isNotNull()), lang_col, text_col)

    def run(batches: Batches) -> Batches:
        totals: dict[str, np.ndarray] = {}
        for piece in pieces(batches, "text"):
            names = np.asarray(piece.column("id").cast(pa.string()).to_pylist(), object)
            feature, row = _trigrams(*flat(piece.column("text")))
            for name in set(names):
                own = (names == name)[row]
                totals[name] = totals.get(name, 0) + np.bincount(feature[own], minlength=FEATURES)
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield record({"lang": pa.array([name] * len(at), pa.string()), "feature": at, "n": counts[at].astype(np.int64)})

    names = [r[0] for r in labelled.select(F.col("id").cast("string")).distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names.sort()
    counts = np.zeros((len(names), FEATURES))
    for r in mapped(labelled, run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[names.index(r.lang), r.feature] = r.n
    smooth = counts + 0.5
    return TextModel(names, np.log(smooth / smooth.sum(axis=1, keepdims=True)))


def _evidence(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), HOST, 1))
    return pages.select(
        F.col(f"`{id_col}`").alias("id"),
        host.alias("host"),
        F.lower(F.regexp_extract(html, DECLARED, 1)).alias("declared"),
        F.regexp_replace(html, SKIPPED, " ").cast("binary").alias("text"),
    )


def _softmax(scores: list[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    raised = F.transform(F.array(*scores), lambda s: F.exp(s - top))
    return F.transform(raised, lambda s: s / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(
    pages: DataFrame,
    model: TextModel,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    strength: float = 5.0,
) -> DataFrame:
    """Per page: ``id_col``, ``language``, ``probability``, ``text_language``, ``declared`` (null if none), ``host``.

    Whole pages are read.  A page without text is decided by its other evidence; a null or odd address has the empty host
    and suffix; null ids and repeated rows are judged row by row; an empty table gives an empty result; other
    columns are ignored.  Ties go to the language that sorts first.  The model needs at least one language.
    """
    if not model.languages:
        raise ValueError("the text model knows no language")
    k = len(model.languages)
    kind = pages.select(f"`{id_col}`").schema[0].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches: Batches) -> Batches:
        own = TextModel(*shared.value)
        for piece in pieces(batches, "text"):
            scores = own.scores(*flat(piece.column("text")))
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield record(
                {c: piece.column(c) for c in ("id", "host", "declared")}
                | {f"s{i}": scores[:, i] for i in range(k)}
                | {f"g{i}": p[:, i] for i in range(k)}
            )

    numbers = ", ".join(f"{c}{i} double" for c in "sg" for i in range(k))
    judged = mapped(_evidence(pages, id_col, url_col, html_col), run, f"id {kind}, host string, declared string, {numbers}")
    judged = written(judged.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)))

    sums = lambda tag: [F.sum(f"g{i}").alias(f"{tag}{i}") for i in range(k)] + [F.count("*").alias(f"{tag}n")]
    hosts = written(judged.groupBy("suffix", "host").agg(*sums("h")))
    again = lambda tag: [F.sum(f"h{i}").alias(f"{tag}{i}") for i in range(k)] + [F.sum("hn").alias(f"{tag}n")]
    total = hosts.agg(*again("t")).first()
    n = max(total["tn"] or 0, 1)
    overall = [((total[f"t{i}"] or 0.0) + 1.0 / k) / (n + 1) for i in range(k)]
    suffixes = hosts.groupBy("suffix").agg(*again("x"))
    hosts = hosts.join(suffixes, "suffix")
    declared = judged.groupBy("declared").agg(*sums("d"))

    placed = judged.join(hosts, ["suffix", "host"]).join(declared, "declared")
    priors, trust = [], []
    for i, language in enumerate(model.languages):
        above = (F.col(f"x{i}") - F.col(f"g{i}") + F.lit(strength * overall[i])) / (F.col("xn") - 1 + strength)
        priors.append((F.col(f"h{i}") - F.col(f"g{i}") + strength * above) / (F.col("hn") - 1 + strength))
        # P(declared | language) by Bayes from P(language | declared), smoothed towards a declaration that holds.
        holds = F.when(F.col("declared") == language, 0.8).otherwise(0.2 / max(k - 1, 1))
        known = (F.col(f"d{i}") - F.col(f"g{i}") + strength * holds) / (F.col("dn") - 1 + strength)
        trust.append(F.when(F.col("declared") == "", 0.0).otherwise(F.log(known / F.lit(overall[i]))))
    scores = [F.col(f"s{i}") + F.log(F.greatest(priors[i], F.lit(1e-9))) + trust[i] for i in range(k)]
    columns = placed.select("id", "host", "declared", *[s.alias(f"f{i}") for i, s in enumerate(scores)], *[f"s{i}" for i in range(k)])
    names = F.array(*[F.lit(name) for name in model.languages])
    best = lambda cells: F.element_at(names, F.array_position(F.array(*cells), F.array_max(F.array(*cells))).cast("int"))
    fused, text = [F.col(f"f{i}") for i in range(k)], [F.col(f"s{i}") for i in range(k)]
    return columns.select(
        F.col("id").alias(id_col),
        best(fused).alias("language"),
        F.array_max(_softmax(fused)).alias("probability"),
        best(text).alias("text_language"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"),
        "host",
    )
