"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into three blocks (23, 23 and 18 bits).  The anchors are the words of the perfect
binary Golay code in each block: every block lies within 3 bits of exactly one code word.  Two
fingerprints at 2 bits or fewer have a common middle point at 1 bit or fewer from both, so each
fingerprint is replicated to the anchors of all points within one bit (half the threshold beyond the
covering radius, from both sides; 16 anchors on average of 2**36) and compared inside each anchor.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardsift.llm.frames import Batches, components, mapped, record, texts, written
from wardsift.llm.text_arrays import LOWER, flat, pieces, words

#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
BLOCKS = ((0, 23), (23, 23), (46, 18))
SEED = 42


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(``id``, ``fp`` as signed 64-bit) per row; texts without words have fingerprint zero."""
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for piece in pieces(batches, "text"):
            prints = simhash(*flat(piece.column("text")), width)
            yield record({"id": piece.column("id"), "fp": prints.view(np.int64)})

    return mapped(texts(docs, id_col, text_col), run, f"id {kind}, fp long")


def simhash(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    n = int(lengths.sum())
    source = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[source + np.repeat(begin, lengths)] = LOWER[data[source + np.repeat(starts, lengths)]]
    plain, stop = out.tobytes(), begin + lengths
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    shift = np.cumsum(sizes) - sizes
    head = np.arange(int(sizes.sum())) - np.repeat(shift, sizes) + np.repeat(first[:-1], sizes)
    tail = np.minimum(head + width, np.repeat(first[1:], sizes)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(plain[a:b], SEED) for a, b in zip(begin[head].tolist(), stop[tail].tolist())], np.uint64
    )
    prints = np.zeros(rows, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, shift[some], axis=0, dtype=np.int32)
        prints[some] = np.packbits(2 * ones > sizes[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return prints


def _remainders() -> np.ndarray:
    """Remainder of every 12-bit head, shifted by 11, modulo the generator."""
    table = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        table = np.where(table >> bit & 1, table ^ (GOLAY << (bit - 11)), table)
    return table


def _nearest() -> np.ndarray:
    """For every 23-bit word the number of the only code word within 3 bits."""
    remainders = _remainders()
    fault = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in itertools.combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            fault[remainders[error >> 11] ^ (error & 2047)] = error
    word = np.arange(1 << 23, dtype=np.int64)
    return ((word ^ fault[remainders[word >> 11] ^ (word & 2047)]) >> 11).astype(np.int16)


_tables: dict[str, np.ndarray] = {}


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for all anchors of points within one bit, each once."""
    if "nearest" not in _tables:
        _tables["nearest"] = _nearest()
    nearest = _tables["nearest"]
    blocks = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in BLOCKS]
    home = [nearest[b].astype(np.int64) for b in blocks]
    base = home[0] | home[1] << 12 | home[2] << 24
    keys = [base]
    for k, (_, n) in enumerate(BLOCKS):
        rest = base & ~(4095 << 12 * k)
        keys += [rest | nearest[blocks[k] ^ (1 << bit)].astype(np.int64) << 12 * k for bit in range(n)]
    table = np.sort(np.stack(keys, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    return np.nonzero(fresh)[0], table[fresh]


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct fingerprints that differ in at most ``max_bits`` (0 to 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("anchors within one bit find links of up to 2 bits")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = np.asarray(batch.column("fp").slice(at, 20_000)).view(np.uint64)
                index, anchor = anchors(part)
                yield record({"anchor": anchor, "fp": part[index].view(np.int64)})

    spread = mapped(prints.select("fp"), run, "anchor long, fp long")
    left, right = spread.select("anchor", F.col("fp").alias("a")), spread.select("anchor", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return left.join(right, "anchor").where(near).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable) per row.

    Copies are collapsed to their fingerprint before any comparison and come back by a join at the end.
    Null and empty texts have fingerprint zero and are linked like any other; a null id is never a
    component's id unless all its ids are null; repeated rows are returned as often as they occur; an
    empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, width))
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(distinct, max_bits))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = known.join(lowest, "root").select("fp", "component_id")
    return prints.join(placed, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id, with all columns.

    Of rows with the same smallest id the one with the smallest fingerprint, then the smallest text digest, stays.
    Groups whose ids are all null keep one row in all.  Texts move once, keyed by id and fingerprint.
    """
    spare = "_fp"
    while spare in docs.columns:
        spare += "_"
    names, at, schema = docs.columns, docs.columns.index(text_col), StructType([*docs.schema.fields, StructField(spare, StringType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            filled = pc.fill_null(batch.column(at), "")
            wide = pa.RecordBatch.from_arrays([*batch.columns, filled], names=[str(i) for i in range(len(names) + 1)])
            for piece in pieces([wide], str(len(names))):
                prints = [f"{p:016x}" for p in simhash(*flat(piece.column(len(names))), width).tolist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(prints, pa.string())], names=[*names, spare])

    groups = simhash_groups(docs, id_col, text_col, width, max_bits)
    chosen = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("fingerprint").alias("_print"))
    tagged = mapped(docs, run, schema)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")) & (F.col(spare) == F.col("_print"))
    order = Window.partitionBy(f"`{id_col}`", spare).orderBy(F.xxhash64(f"`{text_col}`"), F.length(f"`{text_col}`"))
    kept = tagged.join(chosen, same, "left_semi").withColumn("_place", F.row_number().over(order))
    return kept.where("_place = 1").select(*[F.col(f"`{c}`") for c in names])
