"""Named queries and, where SQL can say the same, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.session import FAN_OUT

#: long texts, whose rows cost far more to process than to move
TEXT_TABLES = ("documents", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is the equivalent text on the same parquet tables."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    tasks = int(spark.conf.get(FAN_OUT, "0"))
    return df.repartition(tasks) if tasks and table in TEXT_TABLES else df


def quoted(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
