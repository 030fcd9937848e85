"""Question files, result envelopes, and the result sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_SCHEMA = "db_id string, question string, query string, sql string"


def load_questions(spark: SparkSession, paths: dict[str, str], schema: str = QUESTION_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Several question files as one table, tagged with where each row came from. The parsed
    query stays JSON text: a nested object read into a string column keeps its text.
    Files with one object per line (``multi_line=False``) can be split between tasks."""
    frames = [spark.read.schema(schema).json(path, multiLine=multi_line).withColumn("source", F.lit(tag)) for tag, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_envelope(spark: SparkSession, path: str, key: str, record: str, multi_line: bool = True) -> DataFrame:
    """The records of files shaped ``{"metadata": …, key: [record, …]}``."""
    raw = spark.read.schema(f"`{key}` array<struct<{record}>>").json(path, multiLine=multi_line)
    return raw.select(F.explode(F.col(f"`{key}`")).alias("q")).select("q.*")


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Results by provider. Totals are computed from the rows when asked for, never stored beside them."""
    results.write.mode(mode).partitionBy("provider").parquet(path)
