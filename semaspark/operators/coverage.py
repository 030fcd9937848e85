"""Model statistics and column coverage, counted from model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.operators.derive import ModelTables

KINDS = ("sources", "dimensions", "measures", "joins")


def element_counts(model: ModelTables) -> DataFrame:
    """``db_id, sources, dimensions, measures, joins``: one grouping over all four tables."""
    frames = [getattr(model, kind).select("db_id", *[F.lit(int(k == kind)).alias(k) for k in KINDS]) for kind in KINDS]
    every = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    return every.groupBy("db_id").agg(*[F.sum(k).alias(k) for k in KINDS])


def model_overview(counts: DataFrame) -> DataFrame:
    """Totals, and averages per database rounded to one digit."""
    out = counts.agg(F.count("*").alias("databases"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"total_{k}") for k in KINDS])
    return out.select("*", *[F.round(F.coalesce(F.try_divide(F.col(f"total_{k}"), F.col("databases")), F.lit(0.0)), 1).alias(f"avg_{k}_per_db")
                             for k in KINDS])


def complexity(sources: Column) -> Column:
    return (F.when(sources <= 3, "simple (1-3 tables)").when(sources <= 7, "medium (4-7 tables)")
            .when(sources <= 15, "complex (8-15 tables)").otherwise("very complex (16+ tables)"))


def complexity_distribution(counts: DataFrame) -> DataFrame:
    return counts.groupBy(complexity(F.col("sources")).alias("complexity")).agg(F.count("*").alias("databases"))


def coverage_comparison(full: DataFrame, minimal: DataFrame) -> DataFrame:
    """``layer, files, sources, dimensions, measures, joins`` of two sets of element counts."""
    both = full.withColumn("layer", F.lit("full")).unionByName(minimal.withColumn("layer", F.lit("minimal")))
    return both.groupBy("layer").agg(F.count("*").alias("files"), *[F.sum(k).alias(k) for k in KINDS])


def column_coverage(columns: DataFrame, used: DataFrame) -> DataFrame:
    """``db_id, full_columns, minimal_columns, coverage_ratio, unused_columns``; inputs have db_id,
    table_name, column_name. The unused list is as long as the schema at most."""
    key = [F.lower(c).alias(c) for c in ("table_name", "column_name")]
    marks = used.select("db_id", *key).distinct().withColumn("used", F.lit(True))
    joined = columns.select("db_id", *key).distinct().join(marks, ["db_id", "table_name", "column_name"], "left")
    name = F.concat_ws(".", "table_name", "column_name")
    out = joined.groupBy("db_id").agg(
        F.count("*").alias("full_columns"), F.count_if("used").alias("minimal_columns"),
        F.sort_array(F.collect_list(F.when(F.col("used").isNull(), name))).alias("unused_columns"))
    return out.withColumn("coverage_ratio", F.try_divide(F.col("minimal_columns"), F.col("full_columns")))
