"""Result sinks, response cache, run ledger and model storage."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import LEDGER


def write_result(df: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result table; with ``run_id`` it is added as a partition of ``path``."""
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if run_id is not None:
        writer = writer.partitionBy("run_id")
    writer.save(path)


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write unless the target exists already; an existing target is left alone."""
    write_result(df, path, fmt=fmt, mode="ignore")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rows as JSON lines with fields in name order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


CACHE_SCHEMA = "cache_key string, raw_json string, created_at timestamp"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses; an absent cache is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def append_cache(responses: DataFrame, path: str) -> None:
    """Append fresh ``(cache_key, raw_json)`` rows; readers take the newest per key."""
    fresh = responses.filter(F.col("raw_json").isNotNull())
    fresh.select("cache_key", "raw_json", F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)


def ledger_rows(
    spark: SparkSession,
    experiment: str,
    run_id: str,
    run_ts: datetime,
    entries: Mapping[str, Mapping[str, Any]],
) -> DataFrame:
    """Ledger rows of one run; ``entries`` maps a kind (tag, param, metric, text, artifact) to its values."""
    rows = [
        (experiment, run_id, run_ts, kind, key, None if value is None else str(value))
        for kind, values in entries.items()
        for key, value in values.items()
    ]
    return spark.createDataFrame(rows, LEDGER)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("experiment").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def latest_runs(ledger: DataFrame) -> DataFrame:
    """``(experiment, run_id, run_ts)`` of the newest run per experiment, by full timestamp."""
    newest = F.max(F.struct("run_ts", "run_id"))
    return ledger.groupBy("experiment").agg(newest.alias("_r")).select("experiment", "_r.run_id", "_r.run_ts")


def restore_latest(ledger: DataFrame) -> DataFrame:
    """All ledger rows of the newest run of each experiment."""
    return ledger.join(latest_runs(ledger), ["experiment", "run_id", "run_ts"], "left_semi")


def timed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Attach a row count that is collected while the run's own write happens."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows")), observation


def runtime_metrics(observation: Observation, seconds: float) -> dict[str, float]:
    """Total seconds and seconds per row of a finished run."""
    n = observation.get["n_rows"]
    return {"run_time_total": seconds, "n_rows": n, "run_time_per_sample": seconds / n if n else 0.0}


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
