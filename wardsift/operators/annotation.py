"""Annotation path: cache probe, batch requests, responses, normalised signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.signals import (
    cache_key,
    confidence_derived,
    list_size,
    parse_list_text,
    parse_response,
    quarantine_reason,
    response_action,
    response_confidence,
)
from ..session import cut_lineage
from .frames import compute_once
from .key_filter import key_filter, may_contain

BATCH_SIZE = 5
#: Leading hex digits of a key by which keys are counted before they are numbered.
PREFIX_DIGITS = 4
Annotator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def with_cache_key(
    df: DataFrame, prompt: str, namespace: str, text_col: str = "report_text", extra: str = ""
) -> DataFrame:
    return df.withColumn("cache_key", cache_key(text_col, prompt, namespace, extra))


def latest_responses(cache: DataFrame) -> DataFrame:
    """One response per key.  With ``created_at`` the newest wins, otherwise the greatest text."""
    newest = F.max_by("raw_json", F.struct("created_at", "raw_json")) if "created_at" in cache.columns else F.max("raw_json")
    return cache.groupBy("cache_key").agg(newest.alias("raw_json"))


def probe_cache(keyed: DataFrame, cache: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: keyed rows with their stored response, and the texts still to annotate.

    The rows without their text are written once, with their keys, so a text's key is computed once.  The search runs on them: hits
    carry no text, distinct keys (counted together before the shuffle, so a text copied a million times is one row per
    task) are compared with the stored keys, and one row per missing key is written.  Its text is then picked from the
    input by id and 64-bit hash: a Bloom filter of the missing ids, of bounded size, is probed on the scan, and only what it lets through is
    joined.
    """
    stored = latest_responses(cache)
    narrow = cut_lineage(keyed.withColumn("_text", F.xxhash64("report_text")).drop("report_text"))
    hits = narrow.drop("_text").join(stored, "cache_key")
    one = narrow.groupBy("cache_key").agg(F.min(F.struct(F.col(key).alias("_id"), "_text")).alias("_row"))
    missing = cut_lineage(one.join(stored.select("cache_key"), "cache_key", "left_anti").select("cache_key", "_row.*"))
    texts = keyed.select(F.col(key).alias("_id"), "report_text")
    candidates = may_contain(texts, "_id", key_filter(missing, "_id")).withColumn("_text", F.xxhash64("report_text"))
    same = candidates["_id"].eqNullSafe(missing["_id"]) & (candidates["_text"] == missing["_text"])
    return hits, candidates.join(missing, same).select("cache_key", "report_text").dropDuplicates(["cache_key"])


def numbered_keys(keys: DataFrame, key: str = "cache_key", digits: int = PREFIX_DIGITS) -> DataFrame:
    """(``key``, ``number``): dense numbers from 0 in the order of the keys.

    Keys are counted by prefix (at most ``16 ** digits`` counts come to one task), running totals tell where a prefix begins, and
    a key is ranked inside its prefix.
    """
    prefixed = keys.select(key, F.substring(key, 1, digits).alias("_prefix"))
    before = W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    begins = prefixed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(W.partitionBy("_prefix").orderBy(key)) - 1
    return prefixed.withColumn("_inside", inside).join(F.broadcast(begins), "_prefix").select(key, (F.col("_begin") + F.col("_inside")).alias("number"))


def build_requests(misses: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Group texts into requests of ``batch_size`` in the order of their keys: ``(batch, cache_keys, texts_json)``.

    Keys are numbered without their texts, which are joined to the numbers last, so no task sorts texts.  The last request may be shorter.
    """
    numbered = misses.join(numbered_keys(misses.select("cache_key")), "cache_key")
    item = F.struct((F.col("number") % batch_size).cast("int").alias("id"), F.col("cache_key"), F.col("report_text").alias("text"))
    grouped = (
        numbered.withColumn("batch", F.floor(F.col("number") / batch_size))
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    body = F.to_json(F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["text"].alias("text"))))
    return grouped.select("batch", F.transform("items", lambda i: i["cache_key"]).alias("cache_keys"), body.alias("texts_json"))


def request_body(requests: DataFrame, instructions: str, schema_json: str, allowed_values: str) -> DataFrame:
    """Add ``request``: instructions, record schema, allowed values and the texts of the batch."""
    parts = [instructions, "JSON schema:", schema_json, allowed_values, "Reports:"]
    return requests.withColumn("request", F.concat_ws("\n", *[F.lit(p) for p in parts], F.col("texts_json")))


def unpack_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``(cache_key, raw_json)`` per requested text, matched to its batch response by position.

    ``responses`` holds ``(batch, raw_json)`` with a JSON array per batch.  A position
    without a record (short, broken or absent response) gives a null ``raw_json``; the other
    records of the batch are kept.
    """
    wanted = requests.select("batch", F.posexplode("cache_keys").alias("pos", "cache_key"))
    records = F.from_json("raw_json", "array<string>")
    got = responses.select("batch", F.posexplode(records).alias("pos", "raw_json"))
    return wanted.join(got, ["batch", "pos"], "left").select("cache_key", "raw_json")


def annotate(misses: DataFrame, annotator: Annotator) -> DataFrame:
    """Run a user's annotator over the misses: pandas batches in, ``(cache_key, raw_json)`` out."""
    return misses.select("cache_key", "report_text").mapInPandas(annotator, "cache_key string, raw_json string")


def per_text(fn: Callable[[str], str]) -> Annotator:
    """Annotator from a function of one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "raw_json": [fn(t) for t in batch["report_text"]]})

    return run


def per_batch(fn: Callable[[list[str]], list[str]], batch_size: int = BATCH_SIZE) -> Annotator:
    """Annotator from a function of a list of texts; missing answers become null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["report_text"].tolist()
            answers: list[str | None] = []
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                got = list(fn(part))[: len(part)]
                answers += got + [None] * (len(part) - len(got))
            yield pd.DataFrame({"cache_key": batch["cache_key"], "raw_json": answers})

    return run


def normalize_responses(df: DataFrame, raw_col: str = "raw_json") -> DataFrame:
    """Add the signal columns of an annotator record, and ``quarantine_reason`` for unusable ones."""
    parsed = compute_once(compute_once(df, {raw_col: F.col(raw_col)}), {"_record": parse_response(raw_col)})
    record = F.col("_record")
    signals = parsed.withColumns(
        {
            "expected_action_llm": response_action(record),
            "severity": F.coalesce(record["severity"], F.lit("unknown")),
            "risk_factors": parse_list_text(record["risk_factors"]),
            "uncertainty_level": F.coalesce(record["uncertainty_level"], F.lit("unknown")),
            "missing_information": parse_list_text(record["missing_information"]),
            "confidence": response_confidence(record),
            "quarantine_reason": quarantine_reason(F.col(raw_col), record),
        }
    )
    return signals.withColumns(
        {
            "confidence_derived": confidence_derived("uncertainty_level"),
            "n_risk_factors": list_size("risk_factors"),
            "n_missing_information": list_size("missing_information"),
        }
    ).drop("_record")


def split_quarantine(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, quarantined)`` rows of :func:`normalize_responses`."""
    good = normalized.filter(F.col("quarantine_reason").isNull()).drop("quarantine_reason")
    return good, normalized.filter(F.col("quarantine_reason").isNotNull())


def attach_truth(signals: DataFrame, reports: DataFrame, key: str = "case_id") -> DataFrame:
    """Truth, clarity and domain joined to the signals by key."""
    return signals.join(reports.select(key, "expected_action", "clarity", "domain"), key)


def value_rules(df: DataFrame, levels: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """Add ``violations``: which allowed-value rules a record breaks."""
    rules = {
        "severity": ~F.col("severity").isin(*levels),
        "uncertainty_level": ~F.col("uncertainty_level").isin(*levels),
        "confidence_range": ~F.col("confidence").between(0.0, 1.0),
        "confidence_with_missing_information": (F.col("n_missing_information") > 0) & (F.col("confidence") >= 0.5),
    }
    marks = [F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*marks)))
