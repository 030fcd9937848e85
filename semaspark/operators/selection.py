"""Selections that stay exact and parallel when one group holds most of the rows."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semaspark.session import cut_lineage, sized

SALTS = 64


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str], name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1.

    A group is divided by a hash of its ``spread`` columns, which should be nearly unique; each
    part keeps its first ``n`` rows, so the final sort of a group sees at most ``n`` rows per
    part, however large the group is. ``order`` must be a total order for the result to be
    repeatable."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    kept = salted.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n).drop("__r", "__salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= n)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], bins: int = 4096,
                      gather: int = 100_000) -> DataFrame:
    """Exact interpolated percentiles per group, without sorting, gathering or shuffling a group.

    A histogram over the value range of a group, combined on the map side, tells in which bin each
    wanted rank lies; only values of that bin go on, with ``bins`` times narrower bounds, read once
    for all ranks that share them. Rounds end when what is left per wanted rank fits into one small
    task, or is a single value; its equal values are counted, again on the map side first. So the
    input is read again each round, and what is shuffled are bins and the values of the bins hit.
    Only finite values are binned: the infinities and NaN, the greatest of all, are bins of their
    own. Where there are more groups than may be sent to every executor, equal values are counted
    once and then joined by group with salts.
    ``keys`` may be empty; NULL is a group like any other. NULL values are ignored, as in any aggregate."""
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null").withColumn("n", F.lit(1).cast("bigint"))
    finite = F.col("v").between(-sys.float_info.max, sys.float_info.max)
    odd = {"low_n": F.col("v") == float("-inf"), "high_n": F.col("v") == float("inf"), "nan_n": F.isnan("v")}
    groups, small = sized(data.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"),
        *(F.sum(F.when(test, F.col("n")).otherwise(0)).alias(c) for c, test in odd.items())))
    if not small:
        data = cut_lineage(data.groupBy(*keys, "v").agg(F.sum("n").alias("n")))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("stat"), F.lit(p).alias("p"), F.lit(up).alias("up"))
                                for name, p in fractions.items() for up in (0, 1)]))
    wanted = groups.select("*", ranks.alias("w")).select(
        *keys, "w.stat", "w.p", "w.up", "total", "lo", "hi", *odd,
        F.least((F.floor((F.col("total") - 1) * F.col("w.p")) + F.col("w.up")).cast("bigint"), F.col("total") - 1).alias("rank"))
    # Where the rank falls: (condition, value of the bin or None for the finite ones, rows below, rows inside).
    top = F.col("total") - F.col("nan_n")
    zones = [(F.col("rank") < F.col("low_n"), float("-inf"), F.lit(0), F.col("low_n")), (F.col("rank") >= top, float("nan"), top, F.col("nan_n")),
             (F.col("rank") >= top - F.col("high_n"), float("inf"), top - F.col("high_n"), F.col("high_n"))]
    chosen = {"lo": F.col("lo"), "hi": F.col("hi"), "below": F.col("low_n"), "inside": top - F.col("high_n") - F.col("low_n")}
    for test, v, below, inside in reversed(zones):
        chosen = {c: F.when(test, new).otherwise(chosen[c]) for c, new in (("lo", F.lit(v)), ("hi", F.lit(v)), ("below", below), ("inside", inside))}
    wanted = cut_lineage(wanted.select(*keys, "stat", "p", "up", "total", chosen["lo"].alias("lo"), chosen["hi"].alias("hi"),
                                       chosen["below"].cast("bigint").alias("below"), chosen["inside"].cast("bigint").alias("inside"), "rank", F.lit(False).alias("stuck")))
    unsettled = (F.col("inside") > gather) & (F.col("lo") < F.col("hi")) & ~F.col("stuck")
    while not (open_ := wanted.filter(unsettled)).isEmpty():
        # Bounds that no longer move hold few distinct values; only such a rank leaves the loop.
        wanted = cut_lineage(wanted.filter(~unsettled).unionByName(_narrow(_histogram(data, open_, keys, bins), open_, keys)))
    # What is left of each wanted rank is small: its cumulative counts give the value.
    left = _inside(data, wanted, keys).groupBy(*keys, "lo", "hi", "v").agg(F.sum("n").alias("n"))
    window = Window.partitionBy(*keys, "stat", "up").orderBy("v")
    at = _same(left, wanted, [*keys, "lo", "hi"]).withColumn("seen", F.col("below") + F.sum("n").over(window)).filter("seen > rank")
    values = at.groupBy(*keys, "stat", "up").agg(F.min("v").alias("v"), F.first("p").alias("p"), F.first("total").alias("total"))
    both = values.groupBy(*keys, "stat").agg(
        F.max(F.when(F.col("up") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("v"))).alias("b"),
        F.first("p").alias("p"), F.first("total").alias("total"))
    position = (F.col("total") - 1) * F.col("p")
    lower = F.floor(position)
    part = position - lower
    mixed = F.col("a") + (F.col("b") - F.col("a")) * part
    result = both.select(*keys, "stat", F.when((position == lower) | (F.col("a") == F.col("b")), F.col("a")).otherwise(mixed).alias("x"))
    if not keys:
        return result.agg(*[F.max(F.when(F.col("stat") == n, F.col("x"))).alias(n) for n in fractions])
    return result.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == n, F.col("x"))).alias(n) for n in fractions])


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of equal groups; NULL is equal to NULL."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"__{k}" for k in keys])


def _same(left: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Counted values or bins with the ranks that look into them."""
    wanted, _ = sized(wanted)
    return join_groups(left, wanted, columns)


def _inside(data: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inside the bounds of a wanted rank of their group, once for all ranks with these bounds. A short
    list of bounds is sent to the rows; a long one is spread over salts, so that a hot group is not one task."""
    bounds, small = sized(wanted.select(*keys, "lo", "hi").distinct())
    if not (small and keys):
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        bounds = bounds.withColumn("__s", salts)
        bounds, keys = F.broadcast(bounds) if small else bounds, [*keys, "__s"]
        data = data.withColumn("__s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return join_groups(data, bounds, keys).filter("v >= lo and v <= hi").drop("__s")


def _histogram(data: DataFrame, wanted: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Count, least and greatest value of each bin between each two bounds that are wanted."""
    # halves first: hi - lo may overflow at the ends of the double range
    width = (F.col("hi") / bins - F.col("lo") / bins)
    number = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1))
    return _inside(data, wanted, keys).withColumn("bin", number).groupBy(*keys, "lo", "hi", "bin").agg(
        F.sum("n").alias("count"), F.min("v").alias("blo"), F.max("v").alias("bhi"))


def _narrow(histogram: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks with the bounds of the bin that holds them."""
    window = Window.partitionBy(*keys, "stat", "up").orderBy("bin")  # at most ``bins`` rows each
    seen = _same(histogram, wanted, [*keys, "lo", "hi"]).withColumn("seen", F.col("below") + F.sum("count").over(window))
    hit = seen.filter((F.col("seen") > F.col("rank")) & (F.col("seen") - F.col("count") <= F.col("rank")))
    return hit.select(*keys, "stat", "p", "up", "total", F.col("blo").alias("lo"), F.col("bhi").alias("hi"),
                      (F.col("seen") - F.col("count")).alias("below"), F.col("count").alias("inside"), "rank",
                      ((F.col("lo") == F.col("blo")) & (F.col("hi") == F.col("bhi"))).alias("stuck"))


def pareto(df: DataFrame, cost: str, gain: str, bins: int = 256) -> DataFrame:
    """Rows that no other row beats: none is as cheap with more gain, or cheaper with as much.

    The cost axis is cut into ranges of about equal row counts. A row must beat the best gain
    of all cheaper ranges, a table of ``bins`` rows, and the running best within its range.
    Ties on both values stay in."""
    best = df.groupBy(F.col(cost).alias("c")).agg(F.max(gain).alias("g"))
    # A hashed part of the rows has a small frontier of its own; only those rows go on.
    part = Window.partitionBy("part").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    local = (best.withColumn("part", F.pmod(F.xxhash64("c", "g"), F.lit(bins))).withColumn("prev", F.max("g").over(part))
             .filter("prev is null or g > prev").select("c", "g"))
    local = cut_lineage(local)
    bounds = local.agg(F.percentile_approx("c", [i / bins for i in range(1, bins)]).alias("b")).scalar()
    ranged = local.withColumn("bounds", bounds).withColumn("bin", F.size(F.filter("bounds", lambda b: b < F.col("c")))).drop("bounds")
    tops = ranged.groupBy("bin").agg(F.max("g").alias("top"))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
    before = tops.select("bin", F.max("top").over(earlier).alias("before"))
    within = Window.partitionBy("bin").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    frontier = (ranged.withColumn("prev", F.max("g").over(within)).join(F.broadcast(before), "bin")
                .filter("(prev is null or g > prev) and (before is null or g > before)").select("c", "g"))
    return df.join(frontier, (df[cost] == frontier["c"]) & (df[gain] == frontier["g"]), "left_semi")
