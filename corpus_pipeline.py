"""A cleaned and weighted training corpus from ``documents``, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.  The first four return the columns of
``documents``; the last adds ``mix_rate``, the expected number of copies of a document in the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.registry import PACKAGES, query
from wardsift.llm.op1_decontamination import drop_contaminated
from wardsift.llm.op2_simhash import one_of_each_group
from wardsift.llm.op6_substrings import without_repeats
from wardsift.llm.op8_quality import drop_rejected
from wardsift.llm.op9_mixing import label_domains, with_rates
from wardsift.session import ensure_checkpoint_dir, ship_packages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship_packages(spark, *PACKAGES)
    return drop_rejected(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    ship_packages(spark, *PACKAGES)
    return one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go; ``n_chars`` follows the text."""
    ship_packages(spark, *PACKAGES)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_packages(spark, *PACKAGES)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate in the mixture."""
    ship_packages(spark, *PACKAGES)
    return with_rates(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Fingerprints, components and fitted rates are beyond SQL; ``tests/llm/test_pipeline.py`` has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to a new folder in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


query("pipeline", ORACLE_SQL)(run)
