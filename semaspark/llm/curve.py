"""Shards along a Hilbert curve through several columns, for files that a filter on any of them can skip.

Each column becomes one axis of ``2^BITS`` cells of about equally many rows: a value's cell is the share of rows with a
lesser value, counted exactly. Texts are counted value by value. Whole numbers are counted by ``2^FINE``
equal steps between least and greatest ("linear") or by 32 steps an octave ("octaves"), so what is counted there is
bounded; null is the least value. The place of a row's cells on the curve is its index (Skilling's transposition, in
numpy over Arrow batches). Rows are sorted by index over all executors and cut into runs; neighbours on the curve
are neighbours on every axis, so each file covers a small box.

Law ``rows``: run s has the places from ceil(s N / n) on, so counts differ by one at most. Within a cell of the curve rows go by
checksum of the text, then id (null last), so equal texts of a cell are neighbours; rows that agree in all take any order
among themselves. A hot value has one cell on its axis, and the other axes and a stored row number split it: no sort
key is shared. Null text counts as empty. Empty tables give no rows; other columns are kept by ``shard`` and not
read by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaspark.llm.frames import free_name, salted_join, stage, table

BITS = 8
FINE = 12
SHARDS = 24


@dataclass(frozen=True)
class Axis:
    """A column and how its values are counted: ``values`` (text), ``linear`` or ``octaves`` (whole numbers)."""

    column: str
    kind: str


DOCUMENTS = (Axis("lang", "values"), Axis("source", "values"), Axis("size", "octaves"), Axis("doc_id", "linear"))


def offsets(staged: DataFrame, part: str, value: Column) -> Column:
    """What the parts before a row's part sum to, for a table staged in sorted parts: one number a part."""
    sums = staged.groupBy(part).agg(F.sum(value).alias("n")).orderBy(part).collect()
    before, upto = [], 0
    for r in sums:
        before += [F.lit(r[part]), F.lit(upto).cast("long")]
        upto += r["n"]
    return F.element_at(F.create_map(*before), F.col(part)) if before else F.lit(0).cast("long")


def whole(top: Column, bottom: Column) -> Column:
    """Exact integer quotient; the quotient of decimals would round up beside a whole number."""
    return F.call_function("div", top.cast("decimal(38,0)"), bottom.cast("decimal(38,0)"))


def _step(df: DataFrame, axis: Axis) -> Column:
    """The value that is counted; monotone in the column."""
    col = F.col(axis.column)
    if axis.kind == "values":
        return col
    if axis.kind == "octaves":
        # The exponent and five more bits of the number, as a float has them.
        top = F.length(F.bin(col)) - 1
        bits = F.expr(f"shiftright(`{axis.column}`, greatest(length(bin(`{axis.column}`)) - 6, 0))")
        return F.when(col < 1, 0).otherwise(top * 64 + bits).cast("long")
    if axis.kind != "linear":
        raise ValueError(f"axis {axis.column}: unknown kind {axis.kind}")
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None:
        return F.lit(None).cast("long")
    wide = col.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return whole(wide * (1 << FINE), F.lit(Decimal(high - low + 1)))


def cells(df: DataFrame, axis: Axis, bits: int = BITS) -> DataFrame:
    """value, cell: the share of rows with a lesser value, in ``2^bits`` steps; one row per counted value."""
    counts = df.groupBy(_step(df, axis).alias("value")).agg(F.count("*").alias("n"))
    placed = stage(counts.orderBy(F.col("value").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "values")
    here = Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    total = placed.agg(F.sum("n")).first()[0] or 1
    before = offsets(placed, "part", F.col("n")) + F.coalesce(F.sum("n").over(here), F.lit(0))
    share = whole(before.cast("decimal(20,0)") * (1 << bits), F.lit(total))
    return stage(placed.select("value", share.cast("int").alias("cell")), "cells")


def hilbert(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the curve of points with ``bits`` bits on each axis; bits times axes may be 63 at most."""
    x = [a.astype(np.int64).copy() for a in axes]
    for level in range(bits - 1, 0, -1):
        one, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(len(x)):
            turned = (x[i] & one) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ flips) >> level) & 1)
    return out


def curve_index(cols: list[Column], bits: int = BITS) -> Column:
    if bits * len(cols) > 63:
        raise ValueError("bits times axes may be 63 at most")

    @F.arrow_udf("long")
    def index(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for axes in batches:
            yield pa.array(hilbert([a.to_numpy(zero_copy_only=False) for a in axes], bits))

    return index(*cols)


def place(df: DataFrame, axes: tuple[Axis, ...], bits: int = BITS, name: str = "curve") -> DataFrame:
    """``df`` with each row's index along the curve through ``axes``."""
    found, out = [], df
    for axis in axes:
        value, cell = free_name(out, "value"), free_name(out, "cell")
        side = cells(df, axis, bits).toDF(value, cell)
        step = free_name(out, "step")
        out = salted_join(out.withColumn(step, _step(df, axis)), side.withColumnRenamed(value, step), step, F.struct(*df.columns)).drop(step)
        found.append(free_name(out, f"axis_{axis.column}"))
        out = out.withColumnRenamed(cell, found[-1])
    return out.withColumn(name, curve_index([F.col(c) for c in found], bits)).drop(*found)


def shard(df: DataFrame, axes: tuple[Axis, ...], n: int = SHARDS, ties: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """The rows of ``df`` with curve, shard and slot, staged in the order of the curve."""
    at, part, far, rank = (free_name(df, x) for x in ("at", "part", "far", "rank"))
    for taken in ("curve", "shard", "slot"):
        if free_name(df, taken) != taken:
            raise ValueError(f"the table has a column {taken} already")
    rows = stage(df.withColumn(at, F.monotonically_increasing_id()), "rows")
    rows = place(rows, axes, bits)
    order = rows.orderBy("curve", *(F.col(c).asc_nulls_last() for c in ties), at)
    sorted_ = stage(order.withColumns({part: F.spark_partition_id(), far: F.monotonically_increasing_id()}).drop(at), "sorted")
    total = sorted_.count()
    ranked = sorted_.withColumn(rank, offsets(sorted_, part, F.lit(1)) + F.col(far).bitwiseAND((1 << 33) - 1))
    of = whole(F.col(rank).cast("decimal(20,0)") * n, F.lit(max(total, 1))).cast("int")
    first = whole(of.cast("decimal(20,0)") * total + (n - 1), F.lit(n))
    return ranked.withColumns({"shard": of, "slot": F.col(rank) - first}).drop(part, far, rank)


def write_shards(df: DataFrame, path: str, axes: tuple[Axis, ...], n: int = SHARDS, ties: tuple[str, ...] = (), bits: int = BITS) -> None:
    """One folder a shard; rows in it keep the order of the curve, so the ranges in the files' footers are small boxes."""
    shard(df, axes, n, ties, bits).write.partitionBy("shard").parquet(path)


def boxes(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each shard and the least and greatest value of each column: what a reader needs to skip it."""
    sides = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *sides)


def op12_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), "lang", "source")
    done = shard(docs, DOCUMENTS, SHARDS, ("text_crc32", "doc_id"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql(axes: list[str], bits: int, source: str) -> str:
    """The same transposition as one subselect a step; ``source`` has the axes and other columns."""
    out = source
    for level in range(bits - 1, 0, -1):
        one, low = 1 << level, (1 << level) - 1
        for i, a in enumerate(axes):
            first = axes[0]
            turned = f"{a} & {one} <> 0"
            if i == 0:
                step = f"CASE WHEN {turned} THEN xor({a}, {low}) ELSE {a} END AS {a}"
            else:
                step = (f"CASE WHEN {turned} THEN xor({first}, {low}) ELSE xor({first}, xor({first}, {a}) & {low}) END AS {first}, "
                        f"CASE WHEN {turned} THEN {a} ELSE xor({a}, xor({first}, {a}) & {low}) END AS {a}")
            out = f"SELECT * REPLACE ({step}) FROM ({out})"
    for i in range(1, len(axes)):
        out = f"SELECT * REPLACE (xor({axes[i]}, {axes[i - 1]}) AS {axes[i]}) FROM ({out})"
    flips = "0"
    for level in range(bits - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN {axes[-1]} & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    out = f"SELECT *, {flips} AS flips FROM ({out})"
    terms = [f"(((xor({a}, flips) >> {level}) & 1)::BIGINT << {level * len(axes) + len(axes) - 1 - i})" for level in range(bits) for i, a in enumerate(axes)]
    return f"SELECT *, {' + '.join(terms)} AS curve FROM ({out})"


CRC_SQL = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS tab"""
_UTF8 = """CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
  WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
  ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, byte by byte; ``tab`` is the column of ``CRC_SQL``."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: {_UTF8}))"
    whole = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform({codes}, lambda v: v::BIGINT)), lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1]))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, {whole}) END"


_AXES_SQL = f"""SELECT doc_id, size, text_crc32, {', '.join(f"((rank() OVER (ORDER BY {key} NULLS FIRST) - 1) * {1 << BITS}) // n AS {axis}" for axis, key in (
    ("x0", "lang"), ("x1", "source"), ("x2", "length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0))"),
    ("x3", f"((doc_id - low)::HUGEINT * {1 << FINE}) // (high - low + 1)")))} FROM d, s"""

OP12_SQL = f"""
WITH c AS ({CRC_SQL}),
d AS (SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, CAST({crc32_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, c),
s AS (SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM d),
h AS ({_curve_sql(["x0", "x1", "x2", "x3"], BITS, _AXES_SQL)}),
r AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS LAST) - 1 AS rank FROM h),
p AS (SELECT *, CAST(rank * {SHARDS} // n AS INTEGER) AS shard FROM r, s)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve AS BIGINT) AS curve FROM p
"""
