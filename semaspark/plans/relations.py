"""Relations between DataFrames: joins, memberships and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.plans.model import Model


def _matches(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]):
    return reduce(lambda a, b: a & b, [left[x] == right[y] for x, y in on])


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "left") -> DataFrame:
    """Left outer unless told otherwise, like every declared join."""
    return left.join(right, _matches(left, right, on), how)


def where_in(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    return left.join(right, _matches(left, right, on), "left_semi")


def where_not_in(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], null_aware: bool = False) -> DataFrame:
    """Rows of ``left`` without a partner. ``null_aware`` keeps the rule of SQL ``NOT IN``
    for one column: a NULL on the right leaves no row, a NULL on the left leaves only if
    the right side is empty. It costs one small aggregate instead of a forced broadcast."""
    missing = left.join(right, _matches(left, right, on), "left_anti")
    if not null_aware:
        return missing
    (key, other), = on
    facts = right.select(F.count("*").alias("n"), F.count_if(F.col(other).isNull()).alias("gaps"))
    rows, gaps = facts.select("n").scalar(), facts.select("gaps").scalar()
    return missing.filter((rows == 0) | ((gaps == 0) & F.col(key).isNotNull()))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)


def register_views(model: Model) -> None:
    """Make every source visible to SQL text under its own name."""
    for name, source in model.sources.items():
        source.frame().createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text over the session's tables, or over DataFrames passed by name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
