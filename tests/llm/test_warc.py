import gzip
import glob
import hashlib

import pytest

from wardsift.llm.op7_warc import archive_pages, chunk_table, decided, read_chunks


def test_round_trip_of_awkward_payloads(spark, tmp_path):
    body = "x" * 150
    payloads = {1: body, 2: body, 3: "small", 4: "small", 5: None, 6: "", 7: "\r\n\r\n" * 90, 8: "é€" * 700 + "\r\n", 9: "WARC/1.1\r\n\r\n" * 300,
                10: "\r\n" * 511 + "\r", 11: "q" * 64, 12: "q" * 128, 13: body, 14: "\n" * 700, 15: "a\r\n\r\nb" * 333}
    rows = [(i, f"http://h/{i}\r\nX: y", p, "clash") for i, p in payloads.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    folder = str(tmp_path / "warc")
    got = {r.page_id: r for r in archive_pages(pages, folder, chunk_bytes=64).collect()}
    assert len(got) == len(rows)
    for i, p in payloads.items():
        data = (p or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 1) if i in (2, 13) else ("response", None))
    chunks = read_chunks(spark, folder).collect()
    assert max(len(c.payload) for c in chunks) <= 64
    for i, p in payloads.items():
        if i not in (2, 13):
            parts = sorted((c.chunk, c.payload) for c in chunks if c.record_id == str(i))
            assert [n for n, _ in parts] == list(range(len(parts)))
            assert b"".join(bytes(b) for _, b in parts) == (p or "").encode()
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/part-*"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(chunks)


def test_chunk_rows_carry_running_digests(spark):
    pages = spark.createDataFrame([("p", None, "abcdefgh" * 40)], "page_id string, url string, html string")
    rows = sorted(chunk_table(decided(pages), 100).collect(), key=lambda r: r.chunk)
    data = b"abcdefgh" * 40
    assert [r.running_digest for r in rows] == [hashlib.sha256(data[:n]).hexdigest() for n in (100, 200, 300, 320)]


def test_null_ids_repeated_rows_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    body = "y" * 100
    rows = [(None, None, body), (3, "u", body), (3, "u", body), (4, "u", body), (None, "u", "z" * 200), (None, "u", "z" * 200)]
    got = archive_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == [
        (0, "response", 0, 200), (0, "response", 0, 200), (0, "revisit", 3, 100), (3, "response", 0, 100), (3, "response", 0, 100), (4, "revisit", 3, 100)]
    assert archive_pages(spark.createDataFrame([], schema)).count() == 0


def test_last_record_of_a_file_may_end_in_line_breaks(spark, tmp_path):
    ends = ["", "\r\n", "\r\n\r\n", "\r\n\r", "\r\n\r\n\r\n", "\r", "\n", "\n\r\n"]
    for i, end in enumerate(ends):
        page = spark.createDataFrame([(i, "u", "<p>body</p>" + end)], "page_id long, url string, html string").coalesce(1)
        data = ("<p>body</p>" + end).encode()
        (got,) = archive_pages(page, str(tmp_path / f"warc/part={i}")).collect()
        assert (got.page_id, got.payload_bytes, got.payload_digest) == (i, len(data), hashlib.sha256(data).hexdigest())
    together = read_chunks(spark, str(tmp_path / "warc")).collect()  # files follow each other in one task
    assert sorted((int(c.record_id), bytes(c.payload).decode()) for c in together) == [(i, "<p>body</p>" + e) for i, e in enumerate(ends)]


def test_archive_that_ends_inside_a_record_raises(spark, tmp_path):
    page = spark.createDataFrame([(1, "u", "<p>body</p>" * 20)], "page_id long, url string, html string").coalesce(1)
    archive_pages(page, str(tmp_path / "whole")).collect()
    (part,) = glob.glob(str(tmp_path / "whole/part-*"))
    (tmp_path / "cut").mkdir()
    with gzip.open(tmp_path / "cut/part-0.gz", "wb") as f:
        f.write(gzip.open(part).read()[:-30])
    with pytest.raises(Exception, match="inside a record"):
        read_chunks(spark, str(tmp_path / "cut")).collect()
