"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "wardsift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ``conf`` keys use ``__`` in place of dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local session may fall
    back to a temporary folder, because there driver and executors share one machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="wardsift-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_packages(spark: SparkSession, *folders: str) -> None:
    """Send Python packages to the workers, for runs where they are not installed there.

    Only functions that run in Python workers (annotators, joint fits) need this.
    """
    context = spark.sparkContext
    for folder in folders:
        name = f"{os.path.basename(folder)}-{context.applicationId}.zip"
        if any(f.endswith(name) for f in context.listFiles):
            continue
        target = os.path.join(tempfile.mkdtemp(prefix="wardsift-ship-"), name)
        with zipfile.ZipFile(target, "w") as archive:
            for root, _, files in os.walk(folder):
                for file in sorted(f for f in files if f.endswith(".py")):
                    path = os.path.join(root, file)
                    archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
        context.addPyFile(target)
