"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.registry import query
from wardsift.llm.op1_decontamination import contaminated
from wardsift.llm.op11_phrases import collocations
from wardsift.llm.op12_toxicity import toxicity
from wardsift.llm.op13_negatives import hard_negatives
from wardsift.llm.op10_language import identify, train
from wardsift.llm.op2_simhash import simhash_groups
from wardsift.llm.op3_licenses import NOTICES, license_matches
from wardsift.llm.op4_suffixes import suffix_digests
from wardsift.llm.op5_lm import interpolated_scores
from wardsift.llm.op6_substrings import substring_digests
from wardsift.llm.op7_warc import archive_pages
from wardsift.llm.op8_quality import quality_rules
from wardsift.llm.op9_mixing import label_domains, mixing_rates


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


WORD = r"[^\x20\x09-\x0D]+"


def _shingle_sql(name: str, table: str, key: str, width: int = 5) -> str:
    """Distinct word shingles of a table, A-Z lower-cased; a shorter text is one shingle."""
    return rf"""
{name}_words AS (
  SELECT {key}, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM {table}),
{name} AS (
  SELECT {key}, s, min(i) AS i FROM (
    SELECT {key}, i, list_aggregate(w[i:i+{width - 1}], 'string_agg', ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM {name}_words WHERE len(w) > 0))
  GROUP BY {key}, s)"""


OP1_SQL = f"""
WITH {_shingle_sql("d", "documents", "doc_id")}, {_shingle_sql("b", "benchmark", "item_id")},
sizes AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM d JOIN b USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_groups(documents(spark, sf))


_NOTICES_SQL = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())

OP3_SQL = f"""
WITH notices AS (SELECT * FROM (VALUES {_NOTICES_SQL}) AS v(license_id, text)),
{_shingle_sql("d", "documents", "doc_id")}, {_shingle_sql("b", "notices", "license_id")},
sizes AS (SELECT license_id, count(*) AS n_template FROM b GROUP BY license_id)
SELECT doc_id, license_id, n_template, count(*) AS n_shared, min(d.i) - 1 AS first_word
FROM d JOIN b USING (s) JOIN sizes USING (license_id)
GROUP BY doc_id, license_id, n_template HAVING count(*) >= 0.8 * n_template"""


@query("op3_licenses", OP3_SQL)
def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return license_matches(documents(spark, sf))


@query("op4_suffixes")
def op4_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_digests(documents(spark, sf))


@query("op5_lm")
def op5_lm(spark: SparkSession, sf: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf))


OP6_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY list_aggregate(w[i:i+19], 'string_agg', ' ') ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM win, range(0, 20) AS o(k) WHERE again),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""


@query("op6_substrings", OP6_SQL)
def op6_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substring_digests(documents(spark, sf))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS low FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low <> page_id THEN low END AS refers_to
FROM f"""


@query("op7_warc", OP7_SQL)
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf}/pages.parquet"))


OP8_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM t),
wide AS (SELECT *, len(words) AS n FROM w),
runs AS (
  SELECT doc_id, n, i, list_aggregate(words[i:i+2], 'string_agg', ' ') AS w3,
         CASE WHEN i + 9 <= n THEN list_aggregate(words[i:i+9], 'string_agg', ' ') END AS w10,
         CASE WHEN i + 100 <= n THEN list_aggregate(words[i:i+100], 'string_agg', ' ') END AS w101
  FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM wide WHERE n >= 3)),
found AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
         w10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w10) > 1 AS r10,
         w101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w101) > 1 AS r101
  FROM runs),
c3 AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM found, range(0, 3) AS o(k) WHERE r3 GROUP BY doc_id),
c10 AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM found, range(0, 10) AS o(k) WHERE r10 GROUP BY doc_id),
c101 AS (SELECT doc_id, bool_or(r101) AS c FROM found GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS c
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
joined AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.c, 0) AS n_dup_lines, coalesce(c3.c, 0) AS n_repeat_words, coalesce(c10.c, 0) AS n_covered_words,
         coalesce(c101.c, false) AS too_long
  FROM wide LEFT JOIN lines USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c10 USING (doc_id)
  LEFT JOIN c101 USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
       NOT base_failed AND n_covered_words <= CAST(0.30 AS DOUBLE) * n_words AND NOT too_long AS kept,
       n_symbols > CAST(0.3 AS DOUBLE) * n_words AS symbols_failed
FROM judged"""


@query("op8_quality", OP8_SQL)
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(documents(spark, sf), max_symbols=0.3).drop("longest_repeat")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing_rates(documents(spark, sf), label_domains(spark.read.parquet(f"{sf}/labels.parquet")))


@query("op10_language")
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf}/pages.parquet"), train(documents(spark, sf)))


OP11_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
gram AS (
  SELECT lang, k, list_aggregate(w[i:i+k-1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.*, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS head FROM cand) AS c
  JOIN f AS x ON x.lang = c.lang AND x.k = c.head AND x.phrase = list_aggregate(c.w[1:c.head], 'string_agg', ' ')
  JOIN f AS y ON y.lang = c.lang AND y.k = c.k - c.head AND y.phrase = list_aggregate(c.w[c.head+1:], 'string_agg', ' ')),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1),
longer AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT c.* FROM weakest AS c LEFT JOIN longer AS b ON b.lang = c.lang AND b.part = c.phrase AND c.k = 2
  WHERE b.a IS NULL OR 100 * b.a < 50 * c.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


@query("op11_phrases", OP11_SQL)
def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(documents(spark, sf))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a, v WHERE a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


@query("op13_negatives", OP13_SQL)
def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf}/embeddings.parquet"), label=moved)
