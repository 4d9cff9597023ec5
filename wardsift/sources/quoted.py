"""Delimited files with quoted line breaks, split among tasks.

Spark's multi-line mode reads a file in one task, because a line break inside quotes does not end a record and a task that
begins in the middle of a file cannot tell.  Quotes tell: a break ends a record if the number of quotes before it in the file is even
(a doubled quote counts twice and changes nothing).  One pass counts the quotes of every part of a file, the running parity of the counts
(a few numbers per part) gives each part its true state, and a second pass cuts records from there.  The pieces
of a record that crosses the border of parts are put together by a small grouping.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .headers import first_lines

QUOTE = '"'
_PIECES = "path string, block long, place int, closed boolean, body string"
#: Where a piece lies in its part of a file: before its first record's end, a whole record, after its last record's end.
HEAD, WHOLE, TAIL = 0, 1, 2


def _parts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _open_parts(lines: DataFrame) -> DataFrame:
    """(``path``, ``block``, ``open``): does the part begin inside quotes?"""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("path", "block").agg(F.sum(quotes).alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of parts, in order, to whole records and open pieces (``closed`` where a piece ends its record)."""
    part, inside, held, place = None, False, [], WHOLE
    out: list[tuple] = []
    for batch in batches:
        rows = zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("open").to_pylist(), batch.column("value").to_pylist())
        for path, block, is_open, value in rows:
            if (path, block) != part:
                if held:
                    out.append((*part, TAIL if place == WHOLE else HEAD, False, "\n".join(held)))
                part, inside, held, place = (path, block), is_open, [], HEAD if is_open else WHOLE
            held.append(value)
            inside ^= value.count(QUOTE) % 2 == 1
            if not inside:
                out.append((*part, place, True, "\n".join(held)))
                held, place = [], WHOLE
        if out:
            yield _batch(out)
            out = []
    if held:
        yield _batch([(*part, TAIL if place == WHOLE else HEAD, False, "\n".join(held))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, block, place, closed, body = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(closed), pa.array(body)], ["path", "block", "place", "closed", "body"])


def quoted_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(``path``, ``record``) of every record below ``paths``, headers included.

    Records end at a line feed outside quotes (a carriage return before it is dropped).  Blank lines are no records.  An open quote
    at the end of a file ends with it.
    """
    lines = _parts(spark, paths)
    # One row per part of a file.
    placed = lines.join(F.broadcast(_open_parts(lines)), ["path", "block"])
    pieces = placed.select("path", "block", "open", "value").mapInArrow(_cut, _PIECES)
    whole = pieces.where(F.col("place") == WHOLE).select("path", F.col("block"), F.col("body"))
    # Open pieces, a few per part: a tail and the heads up to the one that closes make one record.
    loose = pieces.where(F.col("place") != WHOLE)
    order = W.partitionBy("path").orderBy("block", "place")
    ends = F.sum(F.col("closed").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    stitched = (
        loose.withColumn("_record", F.coalesce(ends, F.lit(0)))
        .groupBy("path", "_record")
        .agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "place", "body"))).alias("_pieces"))
        .select("path", "block", F.array_join(F.transform("_pieces", lambda x: x["body"]), "\n").alias("body"))
    )
    every = whole.union(stitched).withColumn("record", F.regexp_replace("body", "\r$", ""))
    return every.where(F.trim("record") != "").select("path", "record")


def read_quoted_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """CSV files with one header, quoted line breaks included, read by as many tasks as they have parts.

    The columns of ``schema`` are taken by name; missing ones are null.  The header is one line without line breaks in its names; records equal to it
    are skipped.  A record with too few fields is filled with nulls, surplus fields are dropped.
    """
    headers = {bytes(r["line"]) for r in first_lines(spark, paths).collect()}
    if len(headers) != 1:
        raise ValueError(f"{len(headers)} different headers in {paths}")
    header = headers.pop().decode()
    names = spark.range(1).select(F.from_csv(F.lit(header), ", ".join(f"_{i} string" for i in range(header.count(",") + 1)), {"escape": QUOTE})).first()[0]
    names = [n for n in names if n is not None]
    fields = {f.name: f for f in schema}
    wide = StructType([StructField(f"_{i}", fields[n].dataType if n in fields else StringType()) for i, n in enumerate(names)])
    rows = quoted_records(spark, paths).where(F.col("record") != header)
    parsed = rows.select(F.from_csv("record", wide.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": QUOTE, "mode": "PERMISSIVE"}).alias("_row"))
    at = {n: f"_{i}" for i, n in enumerate(names)}
    return parsed.select(*[(F.col("_row")[at[f.name]] if f.name in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
