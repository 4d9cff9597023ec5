"""Benchmark decontamination by size-partitioned MinHash containment search (see ``templates``)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from wardsift.llm.frames import Batches, mapped, record, rows_where, texts
from wardsift.llm.templates import TemplateIndex, blocks, text_shingles
from wardsift.llm.text_arrays import pieces


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
) -> DataFrame:
    """Pairs (``id_col``, ``item_id``, ``n_item``, ``n_shared``) of a document and an item whose distinct
    ``width``-word shingles it holds to ``threshold`` or more.

    All documents are searched for all items, in blocks of items; texts are never shuffled.  Words are
    parted by ASCII white space and A-Z are lower-cased; an item with fewer words is one shingle and matches
    only a document that is the same short sequence.  Null and empty texts match nothing; items with a null id
    are left out; null document ids and repeated rows are returned row by row; equal item ids each
    give their own row; an empty table gives an empty result; other columns are ignored.
    """
    kinds = [d.select(f"`{c}`").schema[0].dataType.simpleString() for d, c in ((docs, id_col), (items, item_id_col))]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, n_item long, n_shared long"
    narrow = texts(docs, id_col, text_col)

    def search(block) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Batches) -> Batches:
            index = TemplateIndex(*shared.value)
            for piece in pieces(batches, "text"):
                row, item, share = index.find(*text_shingles(piece.column("text"), width), threshold)
                sizes = [len(index.sets[i]) for i in item]
                yield record(
                    {
                        "id": piece.column("id").take(pa.array(row)),
                        "item_id": pa.array([index.ids[i] for i in item], schema_of.field("item_id").type),
                        "n_item": pa.array(sizes, pa.int64()),
                        "n_shared": pa.array([round(s * n) for s, n in zip(share, sizes)], pa.int64()),
                    }
                )

        return mapped(narrow, run, schema)

    empty = docs.sparkSession.createDataFrame([], schema)
    schema_of = to_arrow_schema(empty.schema)
    return reduce(DataFrame.union, map(search, blocks(items, item_id_col, item_text_col, width)), empty).withColumnRenamed("id", id_col)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.8,
    width: int = 5,
) -> DataFrame:
    """The rows of ``docs`` that hold no item to ``threshold``, with all their columns, in one pass per block."""
    for block in blocks(items, item_id_col, item_text_col, width):
        docs = _without(docs, block, text_col, threshold, width)
    return docs


def _without(docs: DataFrame, block, text_col: str, threshold: float, width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    index: list[TemplateIndex] = []

    def clean(column: pa.Array) -> np.ndarray:
        if not index:
            index.append(TemplateIndex(*shared.value))
        flags = np.ones(len(column), bool)
        flags[index[0].find(*text_shingles(column, width), threshold)[0]] = False
        return flags

    return rows_where(docs, text_col, clean)
