"""Mixing sources to target weights with hash thresholds; no sort, DataFrame functions only.

Targets. The sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share 150% of all words by weight. A
target above twice its source's size stops there; what it gives up is shared anew by weight.

Thresholds. A document has a fixed 60-bit hash of its id. Sizes are summed by source and hash bucket; the
bucket in which the running sum crosses the budget is the only one that is refined, ten bits at a time, until it holds
one hash. Documents below are in; the boundary hash is in if that brings the sum nearer to the budget. A target
above the source's size takes every document once and its budget for second copies is the rest, so the thresholds
of a source are nested: what takes two copies at a small target takes two at a larger one. Only summed buckets are shuffled,
and a document is never cut, so a source is off its target by half of one document at most.

Null text has no words, a null source is a source of its own. Rows with equal doc_id share a hash and go together; null
doc_ids do too. Sources without words have target 0. Empty tables give no rows. Other columns are kept by ``mix`` and not
read by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import free_name, salted_join, stage, table

WEIGHTS = (5, 2, 1)
BITS = 60
STEP = 10
WORD = r"[^\x20\x09-\x0D]+"


def _hash(doc_id: str) -> Column:
    """60 bits of the id's MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _hash(doc_id).alias("h"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row per source."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Place of each source: how many sources come before it, counted over distinct names only.
    order = totals.orderBy(F.col("source").asc_nulls_last())
    place = order.select("source", "source_size", F.monotonically_increasing_id().alias("far"), F.spark_partition_id().alias("part"))
    place = stage(place, "sources")
    before, upto = {}, 0
    for r in place.groupBy("part").count().orderBy("part").collect():
        before[r["part"]], upto = upto, upto + r["count"]
    if not before:
        return totals.withColumn("target", F.lit(0.0))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part"))
    nth = (start + F.col("far").bitwiseAND((1 << 33) - 1)) % len(weights)
    weighed = place.select("source", "source_size", F.element_at(F.array(*(F.lit(w) for w in weights)), (nth + 1).cast("int")).cast("long").alias("w"))
    full, capped = F.col("source_size") * 2, F.lit(False)
    while True:
        # Twice the words left to share, and the weight that shares them; sources at their limit are out.
        left = weighed.agg(F.sum(F.when(capped, 0).otherwise(F.col("w"))), F.sum("source_size") * 3 - 2 * F.sum(F.when(capped, full).otherwise(0)), F.sum(capped.cast("int"))).first()
        share = F.when(F.lit(not left[0]), 0.0).otherwise((F.col("w") * F.lit(left[1])).cast("double") / F.lit(2 * max(left[0] or 0, 1)).cast("double"))
        above = capped | (share > full.cast("double"))
        if weighed.where(above).count() == left[2]:
            return weighed.select("source", "source_size", F.when(capped, full.cast("double")).otherwise(share).alias("target"))
        capped = above


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """source, cut, full: documents with a hash below ``cut`` take one copy more than ``full``, the others ``full``."""
    budget = F.col("target") - F.when(F.col("target") > F.col("source_size"), F.col("source_size")).otherwise(0)
    todo = goals.select("source", (F.col("target") > F.col("source_size")).cast("long").alias("full"), budget.alias("left"), F.lit(0).cast("long").alias("low"))
    inside, shift, found = rows.select("source", "size", "h"), BITS, None
    while True:
        shift -= STEP
        bucket = F.shiftright("h", shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("first"), F.max("h").alias("last"))
        near = salted_join(sums, todo, "source", F.col("bucket"), "inner")
        # At most 2^STEP buckets a source: the running sum is over those, not over documents.
        by = "PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        near = near.withColumn("before", F.coalesce(F.expr(f"sum(size) OVER ({by})"), F.lit(0)))
        at = near.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("size") >= F.col("left")))
        at = stage(at.select("source", "full", (F.col("left") - F.col("before")).alias("left"), "bucket", "size", "first", "last"), "boundary")
        nearer = F.col("left") * 2 >= F.col("size")
        done = at.where("first = last").select("source", "full", F.when(nearer, F.col("first") + 1).otherwise(F.col("first")).alias("cut"))
        found = done if found is None else found.unionByName(done)
        open_ = at.where("first < last")
        if shift <= 0 or open_.isEmpty():
            break
        todo = open_.select("source", "full", "left", "bucket")
        name = "edge"
        inside = salted_join(inside, todo.select("source", F.col("bucket").alias(name)), "source", F.col("h"), "inner").where(bucket == F.col(name)).drop(name)
        inside = stage(inside, "inside")
        todo = todo.drop("bucket")
    return goals.select("source", (F.col("target") > F.col("source_size")).cast("long").alias("full")).join(
        found.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "full", F.coalesce("cut", F.lit(0)).alias("cut"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, repeats counted; one row per row."""
    rows = stage(sizes(docs, doc_id, text, source), "sizes")
    goals = stage(targets(rows, weights), "targets")
    cuts = stage(thresholds(rows, goals), "cuts")
    side = goals.join(cuts.withColumnRenamed("source", "s"), goals["source"].eqNullSafe(F.col("s"))).drop("s")
    taken = F.col("size") * (F.col("full") + (F.col("h") < F.col("cut")).cast("long"))
    return salted_join(rows, side, "source", F.col("h")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. A document without words stays once."""
    rows = stage(sizes(docs, doc_id, text, source), "sizes")
    goals = stage(targets(rows, weights), "targets")
    names = [free_name(docs, n) for n in ("full", "cut", "copies")]
    cuts = thresholds(rows, goals).select(F.col("source").alias(source), F.col("full").alias(names[0]), F.col("cut").alias(names[1]))
    joined = salted_join(docs, stage(cuts, "cuts"), source, _hash(doc_id))
    empty = F.coalesce(~F.col(text).rlike(WORD), F.lit(True))
    copies = F.when(empty, 1).otherwise(F.col(names[0]) + (_hash(doc_id) < F.col(names[1])).cast("long")).cast("int")
    return joined.withColumn(names[2], F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size * 2) OVER o - source_size * 2 AS capped, sum(w) OVER () - sum(w) OVER o + w AS open_w, sum(source_size) OVER () AS total FROM s
  WINDOW o AS (ORDER BY source_size * 2.0 / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
k AS (SELECT min_by(CAST(total * 3 - capped * 2 AS BIGINT), source_size * 2.0 / w) AS left_words, min_by(CAST(open_w AS BIGINT), source_size * 2.0 / w) AS left_w
  FROM c WHERE source_size * 2.0 >= w * (total * 3 - capped * 2) / (open_w * 2.0)),
g AS (SELECT source, source_size, CASE WHEN CAST(w * left_words AS DOUBLE) / CAST(left_w * 2 AS DOUBLE) > CAST(source_size * 2 AS DOUBLE) THEN CAST(source_size * 2 AS DOUBLE)
  ELSE CAST(w * left_words AS DOUBLE) / CAST(left_w * 2 AS DOUBLE) END AS target FROM s, k),
r AS (SELECT d.*, g.source_size, g.target, CASE WHEN target > source_size THEN 1 ELSE 0 END AS whole,
  target - CASE WHEN target > source_size THEN source_size ELSE 0 END AS budget,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto < budget OR (upto - size < budget AND (budget - (upto - size)) * 2 >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
