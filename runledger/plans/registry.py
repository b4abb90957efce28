"""Named queries: each reads the given tables and, where SQL can say it, has its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runledger.sources.views import Tables, ansi_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause giving the ANSI form of some views, open for more."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({ansi_view(n)})" for n in names) + " "
