"""Registry of queries and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wardsift.session import ship_packages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PACKAGES = tuple(os.path.join(ROOT, name) for name in ("wardsift", "checks"))

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; without ``sql`` only its rows are checked."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_packages(spark, *PACKAGES)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
