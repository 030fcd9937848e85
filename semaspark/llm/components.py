"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspark.llm.frames import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of ``links`` (a, b long) with the least node it is linked with, directly or not.

    Every round links each node to the least of its neighbours, first from above and then from below; rounds
    grow with the logarithm of the longest chain. Minima are summed per task first; each round is written to the shared
    folder. Links to oneself and repeated links don't matter.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = _mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stage(small.distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
