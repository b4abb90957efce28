"""Declared constraints checked as data: (table_name, rule, key, n) per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, table: str, rule: str, key: Column, n: Column) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), n.alias("n")
    )


def unique(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null key are exempt."""
    some = df.dropna(subset=columns)
    found = some.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return _row(found, table, "unique " + ",".join(columns), key, F.col("n"))


def check(df: DataFrame, table: str, rule: str, holds: Column, key: str) -> DataFrame:
    """Rows that break a check; as in SQL an unknown result does not break it."""
    return _row(df.filter(~holds), table, rule, F.col(key), F.lit(1).cast("bigint"))


def references(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values that point nowhere, with how many rows hold them."""
    keys = parent.select(F.col(parent_key).alias(column))
    lost = df.select(column).dropna().groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    lost = lost.join(keys, column, "left_anti")
    return _row(lost, table, f"references {column}", F.col(column), F.col("n"))


def violations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
