"""Shared steps of the operators: narrow inputs, result assembly, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from wardsift.llm.text_arrays import PIECE_BYTES, pieces
from wardsift.session import ensure_checkpoint_dir

Batches = Iterator[pa.RecordBatch]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and UTF-8 ``text`` bytes only, null text as empty; other columns cannot clash."""
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("text"),
    )


def mapped(df: DataFrame, run: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    return df.mapInArrow(run, schema)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy.

    The written copy needs no shuffle files, so Spark may delete those of this step when it ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)  # None unless somebody has set it, also where Spark knows it
    try:
        spark.conf.set(CLEANUP, "true")
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def rows_where(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], max_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of ``docs``, with all columns, whose text ``keep`` flags; it gets the texts of a piece, null as empty."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Batches) -> Batches:
        for batch in batches:
            filled = pc.fill_null(batch.column(at), "")
            wide = pa.RecordBatch.from_arrays([*batch.columns, filled], names=[str(i) for i in range(len(names) + 1)])
            for piece in pieces([wide], str(len(names)), max_bytes):
                out = piece.filter(pa.array(keep(piece.column(len(names)))))
                yield pa.RecordBatch.from_arrays(out.columns[:-1], names=names)

    return mapped(docs, run, docs.schema)


def record(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of an edge table (``a``, ``b``), as (``node``, ``root``).

    Alternates large-star and small-star rounds.  Each round is two hash groupings without a group in
    one task (a minimum per node, joined back, so a hub is split by the adaptive skew join) and is written to the shared
    checkpoint folder; rounds end when the edge table no longer changes.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print_of(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = large.where("a != b")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        kept = large.join(low, "a")
        edges = written(
            kept.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", F.col("low").alias("b")))
            .distinct()
        )
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select(F.col("b"), F.col("b").alias("root")).distinct().join(roots.select(F.col("node").alias("b")), "b", "left_anti"))


def _print_of(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0))).first()
    return row[0], row[1]


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """``df``, written once, with dense numbers from 0 in the column ``name``.

    Rows are numbered inside their partitions; the driver gets one size per partition and sends back where each begins.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(df.withColumn("_inside", inside).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}
    begin, at = [], 0
    for part in sorted(sizes):
        begin.append((part, at))
        at += sizes[part]
    begins = df.sparkSession.createDataFrame(begin, "_part int, _begin long")
    return held.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_inside")).drop("_part", "_begin", "_inside")
