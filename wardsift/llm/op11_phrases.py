"""Phrase collocations from exact n-gram counts in counting quotient filters.

Texts are written once as chunks.  Units of some chunks send their distinct words with counts; words below the least count cannot
be part of a candidate, the others get dense ids (language and word together), which go back to the units by a join.  Tasks then count
packed id pairs and triples in quotient filters (see ``quotient_filter``), and slices of the filters merge by leading bits of
the permuted keys.  Slices are even because keys are permuted, and an n-gram that every text holds is one entry per filter.
A merge takes slices of at most ``FAN`` filters and cuts by at most ``FAN`` prefixes, so rows grow in proportion to the text (with one
more level per factor of ``FAN``).  Scores, drops and ranks are DataFrame operations on the counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardsift.llm.frames import Batches, mapped, numbered, record, written
from wardsift.llm.packed import pack, unpack
from wardsift.llm.quotient_filter import Filter, count, decode, merge, permute, restore, slices
from wardsift.llm.text_arrays import IS_SPACE, LOWER, flat, gathered, row_of, words

#: Bytes that end a piece of text; blanks part words inside a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_GAP = IS_SPACE | _IS_BREAK
SLICE_BYTES = 1 << 22
ENTRIES = 1 << 20
PART_BYTES = 1 << 23
#: Chunks of a unit (as a power of two), whose words are sent together, and words that a task holds before it sums them.
UNIT_BITS = 4
WORDS = 500_000
FAN_BITS = 12
FAN = 1 << FAN_BITS

RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def _occurrences(piece: pa.RecordBatch) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A piece's distinct (``lang``, ``word``) with their counts ``n``; the place of every occurrence among them, and whether the
    next word follows it in the same piece of text."""
    langs = piece.column("id").dictionary_encode()
    data, offsets = flat(piece.column("text"))
    data = LOWER[data]
    starts, ends, first = words(data, offsets, _IS_GAP)
    names = gathered(data, starts, ends).dictionary_encode()
    row, breaks = row_of(first), np.cumsum(_IS_BREAK[data], dtype=np.int32)
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
    wide = max(len(names.dictionary), 1)
    key = langs.indices.to_numpy().astype(np.int64)[row] * wide + names.indices.to_numpy()
    distinct, place, n = np.unique(key, return_inverse=True, return_counts=True)
    lang, word = langs.dictionary.take(pa.array(distinct // wide)), names.dictionary.take(pa.array(distinct % wide))
    return pa.table({"lang": lang.cast(pa.string()), "word": word.cast(pa.binary()), "n": n}), place, follows


def ngram_counts(docs: DataFrame, lang_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``id``, ``lang``, ``word``, ``f``) of words, (``w1``, ``w2``, ``w3``, ``f``) of pairs (``w3`` zero) and triples, both from
    ``least`` occurrences up, and (``lang``, ``n``) with all word occurrences."""
    narrow = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = pack(narrow, "lang", "text")
    unit = F.shiftright("chunk", UNIT_BITS)

    seen = written(mapped(packed, _vocabulary, "unit long, lang string, word binary, n long"))
    totals = seen.groupBy("lang").agg(F.sum("n").alias("n"))
    known = numbered(seen.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "id").withColumn("id", F.col("id") + 1)
    size, text = known.count(), packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if size >= 1 << 32:
        raise ValueError("more than 2 ** 32 frequent words")
    bits = max(1, size.bit_length())

    ids = seen.join(known.select("lang", "word", "id"), ["lang", "word"]).select("unit", F.lit(-1).cast("long").alias("chunk"), "lang", "word", "id", F.lit(None).cast("binary").alias("body"))
    texts = packed.select(unit.alias("unit"), "chunk", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("id"), "body")
    # A unit's words come before its chunks.
    units = ids.union(texts).repartition("unit").sortWithinPartitions("unit", "chunk")
    prefix_bits = min(bits, max(0, math.ceil(math.log2(max(1, text / SLICE_BYTES)))))
    digits = [min(FAN_BITS, prefix_bits - at) for at in range(0, prefix_bits, FAN_BITS)] or [0]

    # A filter holds some megabytes of text, so about FAN of them come to a part; parts are dealt by digest and merge in turn.
    parts = math.ceil(text / (FAN * PART_BYTES)) or 1
    filters = mapped(units, _counting(bits, digits[0]), "shard long, prefix long, entries binary")
    level, depth = filters.select(F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part"), "prefix", "entries"), digits[0]
    while len(digits) > 1 or parts > 1:
        to = depth + (digits.pop(1) if len(digits) > 1 else 0)
        merged = level.groupBy("part", "prefix").applyInPandas(_merging(bits, depth, to), "part long, prefix long, entries binary")
        parts, depth = math.ceil(parts / FAN), to
        level = merged.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)))
    grams = level.groupBy("prefix").applyInPandas(_reading(bits, depth, least), "w1 long, w2 long, w3 long, f long")
    return known, written(grams), totals


def _vocabulary(batches: Batches) -> Batches:
    """Distinct (language, word) of every unit of chunks with their counts."""
    unit, held, rows = None, [], 0
    for batch in batches:
        for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
            if held and chunk >> UNIT_BITS != unit:
                yield from _words_of(unit, held)
                held, rows = [], 0
            unit = chunk >> UNIT_BITS
            for piece in unpack(body):
                held.append(_occurrences(piece)[0])
                rows += len(held[-1])
                if rows > 2 * len(held[0]) and rows > WORDS:
                    held = [_summed(held)]
                    rows = len(held[0])
    if held:
        yield from _words_of(unit, held)


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"])


def _words_of(unit: int, tables: list[pa.Table]) -> Batches:
    for part in _summed(tables).to_batches(max_chunksize=10_000):
        yield record({"unit": np.full(part.num_rows, unit), "lang": part.column("lang"), "word": part.column("word"), "n": part.column("n")})


def _named(lang: pa.Array, word: pa.Array) -> pa.Array:
    """Language and word as one value; a language's bytes come with their length, so no two pairs are alike."""
    names = lang.dictionary_encode()
    heads = pa.array([len(x.encode()).to_bytes(4, "little") + x.encode() for x in names.dictionary.to_pylist()], pa.binary())
    return pc.binary_join_element_wise(heads.take(names.indices), word, pa.scalar(b"", pa.binary()))


def _counting(bits: int, prefix_bits: int) -> Callable[[Batches], Batches]:
    """Units (their words with ids, then their chunks) to slices of filters; a task cuts a filter when it has ``ENTRIES`` entries."""

    def run(batches: Batches) -> Batches:
        shard, held, unit, parts, values, ids = TaskContext.get().partitionId() << 32, [], None, [], None, None
        for batch in batches:
            is_text = np.asarray(batch.column("chunk")) >= 0
            edges = [0, *(np.flatnonzero(np.diff(is_text.astype(np.int8))) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                if not is_text[a]:
                    parts.append(part)
                    continue
                if parts:
                    table = pa.Table.from_batches(parts).combine_chunks()
                    parts, unit = [], table.column("unit")[0].as_py()
                    values, ids = _named(table.column("lang").combine_chunks(), table.column("word").combine_chunks()), table.column("id").to_numpy()
                for body, own in zip(part.column("body"), part.column("unit").to_pylist()):
                    if own != unit:
                        continue  # A unit without a frequent word.
                    for piece in unpack(body):
                        held.append(_grams(piece, values, ids, bits))
                        if sum(len(f.high) for f in held) > ENTRIES:
                            yield from _rows(shard, merge(held, bits), bits, prefix_bits)
                            shard, held = shard + 1, []
        if held:
            yield from _rows(shard, merge(held, bits), bits, prefix_bits)

    return run


def _grams(piece: pa.RecordBatch, values: pa.Array, ids: np.ndarray, bits: int) -> Filter:
    """The pairs and triples of a piece whose words all have ids."""
    table, place, follows = _occurrences(piece)
    at = pc.index_in(_named(table.column("lang").combine_chunks(), table.column("word").combine_chunks()), value_set=values)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    of_place = np.where(known, ids[at.fill_null(0).to_numpy()], 0)
    word = of_place[place]
    joined = follows[:-1] & (word[:-1] > 0) & (word[1:] > 0)
    two = np.flatnonzero(joined)
    three = two[(two + 1 < len(joined)) & joined[np.minimum(two + 1, len(joined) - 1)]]
    third = np.append(np.zeros(len(two), np.int64), word[three + 2])
    grams = np.stack([np.append(word[two], word[three]), np.append(word[two + 1], word[three + 1]), third])
    return count(*permute(grams, bits), np.ones(grams.shape[1], np.uint64), bits)


def _rows(shard: int, whole: Filter, bits: int, prefix_bits: int) -> Batches:
    cut = list(slices(whole, bits, prefix_bits))
    for at in range(0, len(cut), 64):
        some = cut[at : at + 64]
        yield record({"shard": [shard] * len(some), "prefix": [p for p, _ in some], "entries": pa.array([e for _, e in some], pa.binary())})


def _merging(bits: int, depth: int, to: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = merge([decode(e, key[1], bits, depth) for e in rows["entries"]], bits)
        out = list(slices(whole, bits, to))
        return pd.DataFrame({"part": key[0], "prefix": [p for p, _ in out], "entries": [e for _, e in out]})

    return run


def _reading(bits: int, depth: int, least: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = merge([decode(e, key[0], bits, depth) for e in rows["entries"]], bits)
        often = whole.count >= least
        w1, w2, w3 = restore(whole.high[often], whole.low[often], bits)
        return pd.DataFrame({"w1": w1, "w2": w2, "w3": w3, "f": whole.count[often].astype(np.int64)})

    return run


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in exact decimals; a is at most 10 ** 15, so 38 digits hold the product."""
    wide = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in (a, left, right)}
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7, 0)) * {wide[a]} * {wide[a]}) div ({wide[left]} * {wide[right]}) AS BIGINT)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, top: int = 2000) -> DataFrame:
    """Columns of ``RESULT``: each language's first ``top`` phrases of two or three words.

    A-Z are lower-cased.  Texts are cut into pieces at ``BREAKS``, pieces into words at blanks and tabs; a phrase lies inside a piece.
    ``a`` counts its occurrences (``least`` or more), overlaps included; ``l`` and ``r`` those of the two parts of its weakest cut
    (the first of equal ones), and the score is floor(1000000 a a / (l r)) there.  A phrase of two words inside one of three that
    occurs half as often or more is dropped.  Equal scores go by ``a``, then by the phrase's bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    known, grams, totals = ngram_counts(docs, lang_col, text_col, least)
    two, three = grams.where("w3 = 0").drop("w3"), grams.where("w3 > 0")

    def word(n: int) -> DataFrame:
        return known.select(F.col("id").alias(f"w{n}"), F.col("word").alias(f"t{n}"), F.col("f").alias(f"f{n}"), "lang")

    def pair(x: int, y: int) -> DataFrame:
        return two.select(F.col("w1").alias(f"w{x}"), F.col("w2").alias(f"w{y}"), F.col("f").alias(f"f{x}{y}"))

    larger = three.select("w1", "w2", "f").union(three.select(F.col("w2"), F.col("w3"), "f")).groupBy("w1", "w2").agg(F.max("f").alias("_longer"))
    twos = (
        two.join(larger, ["w1", "w2"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < 50 * F.col("f")))
        .join(word(1), "w1").join(word(2).drop("lang"), "w2")
        .select("lang", F.concat_ws(" ", F.decode("t1", "UTF-8"), F.decode("t2", "UTF-8")).alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", _score("a", "l", "r"))
    )
    cuts = (
        three.withColumnRenamed("f", "a").join(pair(1, 2), ["w1", "w2"]).join(pair(2, 3), ["w2", "w3"])
        .join(word(1), "w1").join(word(2).drop("lang", "f2"), "w2").join(word(3).drop("lang"), "w3")
        .withColumns({"_one": _score("a", "f1", "f23"), "_two": _score("a", "f12", "f3")})
    )
    later = F.col("_two") < F.col("_one")
    threes = cuts.select(
        "lang",
        F.concat_ws(" ", *[F.decode(f"t{k}", "UTF-8") for k in (1, 2, 3)]).alias("phrase"),
        "a",
        F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("f23")).alias("r"),
        F.least("_one", "_two").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each of 64 shares of a language keeps its own first rows, so the last ranking has at most 64 * top rows of a language.
    shared = twos.union(threes).withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = shared.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
