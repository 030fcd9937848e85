"""Do the declarations hold? Smoke queries, key, reference and cardinality audits, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.plans.model import Model, quoted
from semaspark.plans.query import run


def smoke_count(model: Model, names: Sequence[str] | None = None) -> DataFrame:
    """``source, row_count`` for every source; one count each, answered from file footers."""
    frames = [run(model, n, aggregate=["row_count"]).select(F.lit(n).alias("source"), "row_count") for n in names or model.sources]
    return reduce(DataFrame.union, frames)


def smoke_group(model: Model, names: Sequence[str] | None = None) -> DataFrame:
    """``source, n_groups, row_count`` of the grouping by the first dimension of each source (its
    first column if it declares none)."""
    frames = []
    for n in names or model.sources:
        source = model.source(n)
        first = source.dimensions[0].name if source.dimensions else source.frame().columns[0]
        grouped = run(model, n, group_by=[("g", quoted(first))], aggregate=["row_count"])
        frames.append(grouped.agg(F.count("*").alias("n_groups"), F.sum("row_count").alias("row_count")).select(
            F.lit(n).alias("source"), "n_groups", "row_count"))
    return reduce(DataFrame.union, frames)


def preview(model: Model, source: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return run(model, source, select="*", order_by=order_by, limit=n)


def smoke_test(spark: SparkSession, model: Model, db_id: str) -> DataFrame:
    """``db_id, source, query_type, passed, output``; a source that cannot be read fails alone."""
    out = []
    for n in model.sources:
        try:
            run(model, n, aggregate=["row_count"]).collect()
            out.append((db_id, n, "count", True, "OK"))
        except (PySparkException, ValueError) as error:
            out.append((db_id, n, "count", False, str(error)))
    return spark.createDataFrame(out, "db_id string, source string, query_type string, passed boolean, output string")


def _message(width: int | None) -> Column:
    return F.col("output") if width is None else F.substring("output", 1, width)


def verdicts(tests: DataFrame, databases: DataFrame, width: int | None = None) -> DataFrame:
    """``db_id, status, reason, sources_tested, failed`` for every database of the catalog: PASS if
    all its sources pass, SKIP if nothing was tested. Messages are whole; ``width`` cuts them for a report."""
    per_db = tests.groupBy("db_id").agg(
        F.count("*").alias("sources_tested"), F.count_if(~F.col("passed")).alias("failed"),
        F.min(F.when(~F.col("passed"), _message(width))).alias("first_error"))
    status = F.when(F.col("sources_tested").isNull(), "SKIP").when(F.col("failed") == 0, "PASS").otherwise("FAIL")
    reason = F.when(status == "SKIP", F.lit("no model")).when(status == "FAIL", F.col("first_error")).otherwise(F.lit(""))
    return databases.select("db_id").distinct().join(per_db, "db_id", "left").select(
        "db_id", status.alias("status"), reason.alias("reason"), F.coalesce("sources_tested", F.lit(0)).alias("sources_tested"),
        F.coalesce("failed", F.lit(0)).alias("failed"))


def validation_summary(verdict: DataFrame) -> DataFrame:
    """``passed, failed, skipped`` over databases."""
    return verdict.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"))])


def first_errors(tests: DataFrame, n: int | None = None, width: int | None = None) -> DataFrame:
    """Failures by database and source, with whole messages; ``n`` and ``width`` shorten the report."""
    out = tests.filter(~F.col("passed")).select("db_id", "source", _message(width).alias("error")).orderBy("db_id", "source", "error")
    return out if n is None else out.limit(n)


def audit_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Is the key unique and complete? ``n_rows, n_keys, duplicate_keys, max_per_key, null_rows, is_key``."""
    cols = [F.col(quoted(k)) for k in key]
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in cols])
    groups = df.groupBy(*cols).agg(F.count("*").alias("n"), F.first(missing).alias("missing"))
    out = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(~F.col("missing")).alias("n_keys"),
        F.count_if(~F.col("missing") & (F.col("n") > 1)).alias("duplicate_keys"),
        F.coalesce(F.max(F.when(~F.col("missing"), F.col("n"))), F.lit(0)).alias("max_per_key"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("null_rows"))
    return out.withColumn("is_key", (F.col("duplicate_keys") == 0) & (F.col("null_rows") == 0))


def _key_counts(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per key with its row counts on both sides: keys are counted, never paired."""
    names = [f"k{i}" for i in range(len(on))]

    def side(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
        return df.select(*[F.col(quoted(c)).alias(n) for c, n in zip(cols, names)],
                         F.lit(int(tag == "l")).alias("l"), F.lit(int(tag == "r")).alias("r"))

    both = side(left, [x for x, _ in on], "l").unionByName(side(right, [y for _, y in on], "r"))
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    return both.groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumn("missing", missing)


def audit_fk(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """``n_rows, null_rows, orphan_rows, matched_rows, match_rate, unreferenced_keys`` of a reference."""
    c = _key_counts(left, right, on)
    total = F.coalesce(F.sum("l"), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(F.col("missing"), F.col("l"))), F.lit(0))
    orphans = F.coalesce(F.sum(F.when(~F.col("missing") & (F.col("r") == 0), F.col("l"))), F.lit(0))
    out = c.agg(total.alias("n_rows"), nulls.alias("null_rows"), orphans.alias("orphan_rows"),
                F.count_if(~F.col("missing") & (F.col("l") == 0)).alias("unreferenced_keys"))
    matched = F.col("n_rows") - F.col("null_rows") - F.col("orphan_rows")
    return out.select("n_rows", "null_rows", "orphan_rows", matched.alias("matched_rows"),
                      F.coalesce(F.try_divide(matched, F.col("n_rows")), F.lit(0.0)).alias("match_rate"), "unreferenced_keys")


def audit_cardinality(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """``max_matches, multi_rows, joined_rows, is_one``: what a join_one would do to the left side.
    The joined size is a sum of products of counts, so the join itself never runs."""
    c = _key_counts(left, right, on)
    used = ~F.col("missing") & (F.col("l") > 0)
    matches = F.when(F.col("missing"), 0).otherwise(F.col("r"))
    out = c.agg(F.coalesce(F.max(F.when(used, F.col("r"))), F.lit(0)).alias("max_matches"),
                F.coalesce(F.sum(F.when(used & (F.col("r") > 1), F.col("l"))), F.lit(0)).alias("multi_rows"),
                F.coalesce(F.sum(F.col("l") * F.greatest(matches, F.lit(1))), F.lit(0)).alias("joined_rows"))
    return out.withColumn("is_one", F.col("max_matches") <= 1)


def audit_model_joins(model: Model) -> DataFrame:
    """The cardinality audit of every ``join_one`` of a model."""
    frames = []
    for name, source in model.sources.items():
        for j in source.joins:
            if j.many:
                continue
            found = audit_cardinality(source.frame(), model.source(j.target).frame(), model.join_keys(source, j))
            frames.append(found.select(F.lit(name).alias("source"), F.lit(j.name).alias("join_name"), "*"))
    return reduce(DataFrame.union, frames)


def missing_columns(columns: DataFrame, modelled: DataFrame) -> DataFrame:
    """Catalog columns that no modelled column covers; both have db_id, table_name, column_name,
    compared without case."""
    key = [F.lower(c).alias(c) for c in ("table_name", "column_name")]
    have = modelled.select("db_id", *key)
    return columns.select("db_id", *key).join(have, ["db_id", "table_name", "column_name"], "left_anti")
