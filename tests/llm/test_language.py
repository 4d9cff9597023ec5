import random
import time

import pytest
from pyspark.sql import functions as F

from wardsift.llm.op10_language import identify, train


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def as_pages(docs):
    body = F.concat(F.lit('<html><script>for(;;){"the of and"}</script><p class="x">'), "text", F.lit("</p></html>"))
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.com/x").alias("url"), body.alias("html"), "lang")


def test_held_out_accuracy_by_text(spark, docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs.where(~held))
    pages = as_pages(docs.where(held))
    got = identify(pages, model).join(pages.select("page_id", "lang"), "page_id")
    assert got.where("text_language = lang").count() > 0.97 * got.count()


def test_other_evidence_decides_short_texts(spark, docs):
    model = train(docs)
    rng = random.Random(1)
    words = {"de": "der die und nicht sch über", "fr": "être éaux ouement queé"}
    rows = [(i, "https://www.beispiel.de:80/x?y", f'<html lang="de">{" ".join(rng.choices(words["de"].split(), k=60))}</html>') for i in range(60)]
    rows += [(100, "https://www.beispiel.de/", "<html></html>"), (101, "https://else.org/", '<HTML class=a LANG=fr-CA><b></b>'),
             (102, None, None), (103, "https://www.beispiel.de/", f'<html lang="de">{words["fr"] * 20}</html>')]
    got = {r.page_id: r for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(got) == len(rows)
    assert got[100].language == "de" and got[100].host == "www.beispiel.de" and got[100].declared is None
    assert got[101].language == "fr" and got[101].declared == "fr"
    assert got[103].text_language == "fr"
    assert all(0.2 < r.probability <= 1 + 1e-9 for r in got.values())


def test_empty_table_nulls_and_repeated_rows(spark, docs):
    model = train(docs.limit(200))
    schema = "page_id long, url string, html string, host string, language string"
    assert identify(spark.createDataFrame([], schema), model).count() == 0
    rows = [(None, "odd", "<html lang='en'>the of", "h", "l"), (3, "", "", None, None), (3, "", "", None, None)]
    got = identify(spark.createDataFrame(rows, schema), model).collect()
    assert sorted(r.page_id or 0 for r in got) == [0, 3, 3]
    with pytest.raises(ValueError):
        identify(spark.createDataFrame(rows, schema), train(spark.createDataFrame([], "lang string, text string")))


def test_markup_is_stripped_in_linear_time(spark):
    from wardsift.llm.op10_language import _evidence

    openings = ["<!--", "<script", "<script>", "<html", "<html ", "<style x", "<", "<!-- -- ", "<html lang ", "<html lang= "]
    rows = [(i, "u", o * (3_000_000 // len(o))) for i, o in enumerate(openings)]
    start = time.time()
    assert _evidence(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").count() == len(rows)
    seen = _evidence(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html").selectExpr("sum(length(text)) AS n", "count(declared) AS d").first()
    assert seen.n < 100 and time.time() - start < 60
    odd = [(1, "u", "a <b>c</b> <!-- d --> e <script>f</script> g <!-- open <p> h"), (2, "u", "a <script>never < closed"), (3, "u", "1 > 0 and 0 < 1")]
    texts = {r.id: " ".join(bytes(r.text).decode().split()) for r in _evidence(spark.createDataFrame(odd, "page_id long, url string, html string"), "page_id", "url", "html").collect()}
    assert texts == {1: "a c e g", 2: "a", 3: "1 > 0 and 0"}


def test_query_reads_every_page_and_beats_text_alone(spark):
    import wardsift.llm.queries  # noqa: F401
    from checks.registry import QUERIES

    got = QUERIES["op10_language"](spark, "/root/testdata/sf0.01")
    assert got.count() == 250
    assert got.where("language = declared").count() >= got.where("text_language = declared").count() > 225
