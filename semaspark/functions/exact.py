"""Sums that do not depend on the order in which partitions arrive.

A value with a known number of decimals is a whole number of small units. Its upper and
lower bits are summed as two longs, which stays in generated code and is several times
faster than a decimal sum; they meet in a decimal once per group. In ANSI mode a sum
beyond a long stops the job, it never wraps.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 20


def exact_parts(col: Column, scale: int) -> dict[str, Column]:
    """Two aggregates that hold the exact sum; each can itself be summed."""
    units = F.rint(col * F.lit(float(10**scale))).cast("bigint")
    return {"hi": F.sum(F.shiftright(units, _BITS)), "lo": F.sum(units.bitwiseAND(F.lit((1 << _BITS) - 1)))}


def exact_total(parts: dict[str, Column], scale: int) -> Column:
    """The double nearest to the exact sum that the parts hold."""
    whole = parts["hi"].cast("decimal(28,0)") * F.lit(Decimal(1 << _BITS)) + parts["lo"].cast("decimal(28,0)")
    return whole.cast("double") / F.lit(float(10**scale))


def exact_sum(col: Column, scale: int = 2) -> Column:
    return exact_total(exact_parts(col, scale), scale)


def exact_avg(col: Column, scale: int = 2) -> Column:
    return F.try_divide(exact_sum(col, scale), F.count(col))
