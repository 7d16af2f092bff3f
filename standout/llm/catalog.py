"""Queries of this subpackage, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["simhash", "mixing", "warc", "language", "fingerprints", "pii", "packing", "neighbours", "scoring", "substrings", "merkle", "divergence", "repair"]


def workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            workers_import(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for name in MODULES:
        import_module(f"standout.llm.{name}")
