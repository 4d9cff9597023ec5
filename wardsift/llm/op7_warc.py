r"""WARC archives by a chunked record table.

A payload is streamed as rows (record, chunk number) of at most ``chunk_bytes``, each with the digest of
all bytes so far, so neither writing nor reading allocates a whole record.  In the archive a chunk is a
WARC segment: the first is a ``response``, the others are ``continuation`` records.  Every WARC record ends
with CR LF CR LF, which is the line separator of Spark's text writer and reader, so archives go through any
file system that Spark knows.  They are gzip files; one task reads one as a stream, whatever
its size, because a row is never longer than a chunk and its header.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardsift.llm.frames import Batches, mapped, record
from wardsift.session import ensure_checkpoint_dir

END = b"\r\n\r\n"
CHUNK_BYTES = 1 << 16
SMALLEST_REVISIT = 100
NAME = "urn:wardsift:record:"
DATE = "2024-01-01T00:00:00Z"

CHUNKS = "record_id string, chunk long, record_type string, refers_to string, url string, last boolean, payload binary, running_digest string, payload_bytes long, payload_digest string"


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest`` and ``first`` (the smallest id with this payload) per page.

    Only ids and digests are grouped; a payload is moved once, keyed by its own id.
    """
    tagged = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = tagged.select("id", "digest", F.octet_length("payload").alias("size")).distinct()
    first = narrow.where(F.col("size") >= SMALLEST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"))
    known = narrow.join(first, "digest").where("first <> id or (id is null and first is not null)")
    revisits = known.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return tagged.join(revisits, same, "left").select("id", "url", "payload", "digest", "first")


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``CHUNKS`` of pages as ``decided`` gives them; a revisit is one row without payload."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, urls, digests, firsts = (batch.column(c).to_pylist() for c in ("id", "url", "digest", "first"))
            rows: list[tuple] = []
            held = 0
            for i, payload in enumerate(batch.column("payload")):
                data = payload.as_buffer()
                running, at, chunk = hashlib.sha256(), 0, 0
                common = (urls[i], data.size, digests[i])
                if firsts[i] is not None:
                    rows.append((ids[i], 0, "revisit", firsts[i], common[0], True, b"", digests[i], *common[1:]))
                    continue
                while chunk == 0 or at < data.size:
                    part = data.slice(at, min(chunk_bytes, data.size - at)).to_pybytes()
                    running.update(part)
                    at += len(part)
                    kind = "continuation" if chunk else "response"
                    rows.append((ids[i], chunk, kind, None, common[0], at == data.size, part, running.hexdigest(), *common[1:]))
                    chunk, held = chunk + 1, held + len(part)
                    if held > 1 << 22:
                        yield _chunks(rows)
                        rows, held = [], 0
            if rows:
                yield _chunks(rows)

    return mapped(pages.withColumns({c: F.col(c).cast("string") for c in ("id", "first")}), run, CHUNKS)


_CHUNK_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.string()]
_CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return record({n: pa.array(v, t) for n, t, v in zip(_CHUNK_NAMES, _CHUNK_TYPES, zip(*rows))})


def name_of(record_id: str | None, chunk: int) -> str:
    return f"<{NAME}{'-' if record_id is None else '=' + record_id.encode().hex()}:{chunk}>"


def id_of(name: str) -> tuple[str | None, int]:
    key, _, chunk = name.strip("<>").removeprefix(NAME).rpartition(":")
    return (None if key == "-" else bytes.fromhex(key[1:]).decode()), int(chunk)


def record_bytes(row: dict) -> bytes:
    """One WARC record, up to but not with the CR LF CR LF that ends it."""
    url = row["url"].replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name_of(row['record_id'], row['chunk'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Segment-Number: {row['chunk'] + 1}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        f"X-Running-Digest: sha256:{row['running_digest']}",
    ]
    if row["record_type"] == "continuation":
        head.append(f"WARC-Segment-Origin-ID: {name_of(row['record_id'], 0)}")
    if row["record_type"] == "revisit":
        head += [
            f"WARC-Refers-To: {name_of(row['refers_to'], 0)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = row["payload"]
    if row["chunk"] == 0:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
        block = http.encode() + block
        head.append("Content-Type: application/http; msgtype=response")
    if row["last"] and row["chunk"]:
        head.append(f"WARC-Segment-Total-Length: {row['payload_bytes']}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block


def write_archives(chunks: DataFrame, folder: str) -> None:
    """Write chunk rows as gzip WARC files below ``folder``; chunks of a record stay together in order."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield record({"value": pa.array([record_bytes(r) for r in batch.slice(at, 64).to_pylist()], pa.binary())})

    lines = mapped(chunks, run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk rows of all archives below ``folder``, each checked against its running digest."""
    lines = spark.read.option("lineSep", END.decode()).text(folder)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Batches) -> Batches:
        state = _Reader()
        for batch in batches:
            rows, held = [], 0
            for file, value in zip(batch.column("file"), batch.column("value")):
                for row in state.feed(file.as_py(), value.as_py()):
                    rows.append(row)
                    held += len(row[6])
                    if held > 1 << 22:
                        yield _chunks(rows)
                        rows, held = [], 0
            if rows:
                yield _chunks(rows)
        if rows := list(state.finish()):
            yield _chunks(rows)

    return mapped(lines, run, CHUNKS)


class _Reader:
    """Byte stream to chunk rows: holds one chunk and one line at most and the digest of the record so far.

    Spark does not tell whether a file's last line had a separator: a payload that ends in CR LF leaves the line CR LF without
    one.  So a separator is added when the next line of the file arrives, and at the end of a file only if a record still lacks it.
    """

    def __init__(self) -> None:
        self.file, self.open, self.running, self.owed = None, bytearray(), hashlib.sha256(), False

    def feed(self, file: str, line: bytes) -> Iterator[tuple]:
        if file != self.file:
            yield from self.finish()
            self.file = file
        if self.owed:
            self.open += END
        self.open += line
        self.owed = True
        while (row := self._next()) is not None:
            yield row

    def finish(self) -> Iterator[tuple]:
        if self.open:
            self.open += END
            while (row := self._next()) is not None:
                yield row
        if self.open:
            raise ValueError(f"archive ends inside a record: {self.file}")
        self.owed = False

    def _next(self) -> tuple | None:
        head_end = self.open.find(END)
        if head_end < 0:
            return None
        version, *lines = self.open[:head_end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at this place: {self.file}")
        head = dict(line.split(": ", 1) for line in lines)
        start, size = head_end + len(END), int(head["Content-Length"])
        if len(self.open) < start + size + len(END):
            return None
        if self.open[start + size : start + size + len(END)] != END:
            raise ValueError(f"record is not ended: {self.file}")
        block = bytes(self.open[start : start + size])
        del self.open[: start + size + len(END)]
        record_id, chunk = id_of(head["WARC-Record-ID"])
        if chunk == 0:
            block, self.running = block[block.index(END) + len(END) :], hashlib.sha256()
        self.running.update(block)
        kind, total = head["WARC-Type"], int(head["X-Payload-Length"])
        told = head["X-Running-Digest"].removeprefix("sha256:")
        if kind != "revisit" and self.running.hexdigest() != told:
            raise ValueError(f"digest of {head['WARC-Record-ID']} does not hold: {self.file}")
        refers = id_of(head["WARC-Refers-To"])[0] if kind == "revisit" else None
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        last = kind == "revisit" or total == 0 or "WARC-Segment-Total-Length" in head or (chunk == 0 and len(block) == total)
        return record_id, chunk, kind, refers, head["WARC-Target-URI"], last, block, told, total, digest


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Write one record per page, read the archives back and return what they hold per page.

    Columns: ``id_col``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.  Of pages with equal
    payloads of 100 bytes or more the smallest id is the response and the others revisit it.  Null
    payloads and addresses are empty; a page with a null id revisits the smallest id, and is a response if
    there is none; a page that occurs twice with the smallest id is a response twice; an empty table gives an
    empty result; other columns are ignored.  Archives stay in ``folder`` (by default a new one in the shared
    checkpoint folder).
    """
    spark = pages.sparkSession
    kind = pages.select(f"`{id_col}`").schema[0].dataType
    folder = folder or f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(chunk_table(decided(pages, id_col, url_col, payload_col), chunk_bytes), folder)
    ended = read_chunks(spark, folder).where("last")
    return ended.select(
        F.col("record_id").cast(kind).alias(id_col),
        "payload_bytes",
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(F.col("running_digest")).alias("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
