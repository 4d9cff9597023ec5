"""First lines of files, without reading the files.

A Python data source with the files in its partitions: a task opens each of its files, reads until the first line ends, and
goes on to the next, so the cost is a few kilobytes per file however large it is.  Files are listed by Spark; they are opened
by ``pyarrow.fs``, which knows local files and the common stores.  Where it does not know a store, Spark's text reader takes one line
of each part of a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1 << 12
FILES_PER_TASK = 64
#: Files in one plan of the text reader's way.
FILES_PER_PLAN = 64


def first_line(uri: str) -> bytes | None:
    """The bytes before the first line break of a file (compressed or not); None for an empty one."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    held = b""
    with files.open_input_stream(path, compression="detect", buffer_size=0) as stream:
        while part := stream.read(STEP):
            held += part
            ends = [at for at in (held.find(b"\n"), held.find(b"\r")) if at >= 0]
            if ends:
                return held[: min(ends)]
    return held or None


class Files(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class HeaderReader(DataSourceReader):
    def __init__(self, uris: list[str]):
        self.uris = uris

    def partitions(self) -> Sequence[InputPartition]:
        return [Files(self.uris[at : at + FILES_PER_TASK]) for at in range(0, len(self.uris), FILES_PER_TASK)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri in partition.uris:
            line = first_line(uri)
            if line is not None:
                yield uri, line


class HeaderSource(DataSource):
    """``spark.read.format("header_lines").option("files", <JSON list of URIs>)``: (``path``, ``line`` as bytes)."""

    @classmethod
    def name(cls) -> str:
        return "header_lines"

    def schema(self) -> str:
        return "path string, line binary"

    def reader(self, schema: object) -> DataSourceReader:
        return HeaderReader(json.loads(self.options["files"]))


def first_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(``path``, ``line``) of every file below ``paths`` that is not empty."""
    uris = sorted(spark.read.text(paths if isinstance(paths, str) else list(paths)).inputFiles())
    if all(_reachable(scheme) for scheme in {urlparse(u).scheme: u for u in uris}.values()):
        spark.dataSource.register(HeaderSource)
        return spark.read.format("header_lines").option("files", json.dumps(uris)).load()
    return _by_text_reader(spark, uris)


def _reachable(uri: str) -> bool:
    try:
        pa.fs.FileSystem.from_uri(uri)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def _by_text_reader(spark: SparkSession, uris: list[str]) -> DataFrame:
    found = []
    for at in range(0, len(uris), FILES_PER_PLAN):
        plan = None
        for uri in uris[at : at + FILES_PER_PLAN]:
            lines = spark.read.text(unquote(uri)).select(F.lit(uri).alias("path"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"))
            first = lines.where("block = 0").limit(1).drop("block")
            plan = first if plan is None else plan.union(first)
        found += [tuple(r) for r in plan.collect()]
    return spark.createDataFrame(found, "path string, line binary")
