"""Escalation over reports that keep arriving as files.

A run over batches that stores each batch's responses before going on is, in Spark, a file stream
with ``foreachBatch``: the stream's checkpoint remembers which files are done, and the cache
remembers which texts are paid for, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.annotation import Annotator
from ..plans.escalate import escalate_by_annotator
from ..schemas import REPORTS


def stream_reports(spark: SparkSession, folder: str, schema: StructType = REPORTS, files_per_batch: int | None = None) -> DataFrame:
    """Report files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def escalate_stream(
    reports: DataFrame,
    annotator: Annotator,
    cache_path: str,
    out_path: str,
    checkpoint_path: str,
    rule_version: str = "v6",
) -> StreamingQuery:
    """Annotate and decide all files present, then stop; call again for later files.

    Each micro-batch writes its own partition in overwrite mode, so a repeated batch replaces
    itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        decided, quarantined = escalate_by_annotator(batch, annotator, cache_path, rule_version)
        decided.write.mode("overwrite").parquet(f"{out_path}/decided/batch_id={batch_id}")
        quarantined.write.mode("overwrite").parquet(f"{out_path}/quarantined/batch_id={batch_id}")

    return (
        reports.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
