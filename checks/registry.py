from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def xsum(expr: str, scale: int = 2) -> str:
    """The exact sum in SQL: whole units first, one division at the end."""
    unit = f"{float(10**scale)}e0"
    return f"CAST(SUM(CAST(round_even(({expr}) * {unit}, 0) AS BIGINT)) AS DOUBLE) / {unit}"


def xavg(expr: str, scale: int = 2) -> str:
    return f"{xsum(expr, scale)} / COUNT({expr})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over several tasks a core: a narrow table is a file of a few MB, which one task would read, and then all that
    is made of its rows would stay in that task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
