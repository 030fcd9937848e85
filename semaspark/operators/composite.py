"""References over several columns, put together from the single-column pairs that catalogs list.

A catalog has one pair per referring column. Pairs between the same two tables belong to one reference if no
column of the target identifies its rows alone but some together do. Which columns do is searched in the data, one
size after the other, and only among sets without a smaller key inside. If several columns refer to one target column (a start and
an end, say), each way to pick one per key column is counted: how many referring rows it finds. The way that finds most
becomes a reference, its pairs are taken out, and the next one is picked from the rest.

All sets of one size are counted in one pass over the target, all ways in one pass over the referring table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, product
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.plans.model import quoted
from semaspark.sources.catalog import Catalog

COMPOSITES = "db_id string, src_idx int, dst_idx int, refs array<int>, src_columns array<string>, dst_columns array<string>, n_rows long, n_found long"


def candidate_pairs(catalog: Catalog) -> DataFrame:
    """``db_id, src_idx, dst_idx`` with their pairs, for tables that refer to two or more columns of another table."""
    pairs = catalog.refs.filter("src_idx <> dst_idx").groupBy("db_id", "src_idx", "src_table", "src_column", "dst_idx", "dst_table", "dst_column").agg(F.min("ref_no").alias("ref_no"))
    pair = F.struct("ref_no", "src_column", "dst_column")
    grouped = pairs.groupBy("db_id", "src_idx", "src_table", "dst_idx", "dst_table").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    return grouped.filter(F.size(F.array_distinct(F.transform("pairs", lambda p: p["dst_column"]))) > 1)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _kind(df: DataFrame, column: str) -> str:
    """The type that values of a column are compared in: whole numbers as long, texts and dates as they are, others by their text."""
    kind = df.select(F.col(quoted(column))).schema[0].dataType.simpleString()
    return "bigint" if kind in _WHOLE else kind if kind in ("date", "boolean") else "string"


def smallest_keys(df: DataFrame, columns: list[str]) -> list[tuple[str, ...]]:
    """The smallest sets of ``columns`` whose values, where none is null, are unique."""
    keys: list[tuple[str, ...]] = []
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    values = df.select(*[F.col(quoted(c)).cast(_kind(df, c)).alias(n) for c, n in names.items()])
    for size in range(1, len(columns) + 1):
        sets = [s for s in combinations(columns, size) if not any(set(k) <= set(s) for k in keys)]
        if not sets:
            break
        # A row goes once per set; equal values meet after each task has counted its own.
        each = values.groupingSets([[F.col(names[c]) for c in s] for s in sets], *names.values())
        counted = each.agg(F.count("*").alias("n"), *[F.grouping(n).alias(f"{n}_out") for n in names.values()])
        whole = reduce(and_, [F.col(n).isNotNull() | (F.col(f"{n}_out") == 1) for n in names.values()])
        used = F.array_compact(F.array(*[F.when(F.col(f"{n}_out") == 0, F.lit(n)) for n in names.values()]))
        repeated = {tuple(r["used"]) for r in counted.filter((F.col("n") > 1) & whole).select(used.alias("used")).distinct().collect()}
        keys += [s for s in sets if tuple(sorted((names[c] for c in s), key=list(names.values()).index)) not in repeated]
    return keys


def inclusion_counts(source: DataFrame, target: DataFrame, key: tuple[str, ...], ways: list[tuple[str, ...]]) -> list[tuple[int, int]]:
    """For each way to refer to ``key``: rows without a null in it, and how many of them are found in the target."""
    kinds = []
    for at, c in enumerate(key):
        seen = {_kind(target, c), *(_kind(source, way[at]) for way in ways)}
        kinds.append(seen.pop() if len(seen) == 1 else "string")
    on = [f"v{at}" for at in range(len(key))]
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(quoted(c)).cast(k).alias(v) for c, k, v in zip(way, kinds, on)]) for i, way in enumerate(ways)]))
    # One row per value with a count per way: the join finds both sides dealt by value already.
    asked = source.select(tagged.alias("t")).select("t.*").dropna(subset=on).groupBy(*on).agg(*[F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(len(ways))])
    there = target.select(*[F.col(quoted(c)).cast(k).alias(v) for c, k, v in zip(key, kinds, on)]).distinct().withColumn("there", F.lit(True))
    totals = [F.coalesce(F.sum(x), F.lit(0)) for i in range(len(ways)) for x in (F.col(f"n{i}"), F.when(F.col("there"), F.col(f"n{i}")))]
    got = asked.join(there, on, "left").agg(*[t.alias(f"t{i}") for i, t in enumerate(totals)]).first()
    return [(got[2 * i], got[2 * i + 1]) for i in range(len(ways))]


def _covers(pairs: list, source: DataFrame, target: DataFrame) -> list[tuple[list, int, int]]:
    """References over several columns in the pairs of two tables: their pairs, referring rows and rows found."""
    columns = list(dict.fromkeys(p["dst_column"] for p in pairs))
    key = next((k for k in smallest_keys(target, columns) if len(k) > 1), None)
    if key is None:
        return []
    by = [[p for p in pairs if p["dst_column"] == c] for c in key]
    ways = [w for w in product(*by) if len({p["src_column"] for p in w}) == len(w)]
    counts = inclusion_counts(source, target, key, [tuple(p["src_column"] for p in w) for w in ways])
    ranked = sorted(zip(ways, counts), key=lambda x: (-x[1][1], [p["ref_no"] for p in x[0]]))
    out, taken = [], set()
    for way, (n, found) in ranked:
        if not taken & {p["ref_no"] for p in way}:
            taken |= {p["ref_no"] for p in way}
            out.append((sorted(way, key=lambda p: p["ref_no"]), n, found))
    return out


def composite_refs(spark: SparkSession, catalog: Catalog, frame: Callable[[str, str], DataFrame | None]) -> DataFrame:
    """One row per reference over several columns, as ``COMPOSITES`` names them. ``frame(db_id, table)`` gives the data; tables without data keep
    their pairs apart. What the driver holds is a row per pair of tables that could have such a reference."""
    rows = []
    for r in candidate_pairs(catalog).toLocalIterator():
        source, target = frame(r["db_id"], r["src_table"]), frame(r["db_id"], r["dst_table"])
        if source is None or target is None:
            continue
        for pairs, n, found in _covers(r["pairs"], source, target):
            rows.append((r["db_id"], r["src_idx"], r["dst_idx"], [p["ref_no"] for p in pairs], [p["src_column"] for p in pairs], [p["dst_column"] for p in pairs], n, found))
    return spark.createDataFrame(rows, COMPOSITES)
