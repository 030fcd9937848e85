"""Derive semantic models from catalogs, for all databases in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaspark.functions.naming import needs_quoting, snake_case, source_name
from semaspark.plans.model import Join, Measure, Model, Source, quoted, rename
from semaspark.session import cut_lineage
from semaspark.sources.catalog import Catalog


@dataclass(frozen=True)
class ModelTables:
    """A derived model as four relations.

    sources     db_id, source, table_name, primary_key (array), level, cyclic
    dimensions  db_id, source, dimension, column_name, needs_quoting
    measures    db_id, source, measure, op, column_name
    joins       db_id, source, ref_no, join_name, target, field, target_field
    """

    sources: DataFrame
    dimensions: DataFrame
    measures: DataFrame
    joins: DataFrame

    def write(self, path: str) -> None:
        for name in ("sources", "dimensions", "measures", "joins"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> ModelTables:
        return ModelTables(*[spark.read.parquet(f"{path}/{n}") for n in ("sources", "dimensions", "measures", "joins")])


def named_columns(columns: DataFrame, mode: str = "compat") -> DataFrame:
    """Each column with its dimension name, whether it needs one, and the field to refer to it by."""
    name = snake_case(F.col("column_name"), mode)
    renamed = (F.lower(name) != F.lower("column_name")) | needs_quoting(F.col("column_name"))
    return columns.select("*", source_name(F.col("table_name"), mode).alias("source"), name.alias("dimension"), renamed.alias("renamed")).withColumn(
        "field", F.when(F.col("renamed"), F.col("dimension")).otherwise(F.col("column_name")))


def derive_dimensions(columns: DataFrame, mode: str = "compat") -> DataFrame:
    """Only columns whose name changes or must be quoted; the others stay usable as they are."""
    return named_columns(columns, mode).filter("renamed").select(
        "db_id", "source", "dimension", "column_name", needs_quoting(F.col("column_name")).alias("needs_quoting"))


def derive_measures(catalog: Catalog, mode: str = "compat") -> DataFrame:
    """``row_count`` per source and four aggregates per numeric column."""
    ops = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(p).alias("p")) for op, p in
                    (("sum", "total"), ("avg", "avg"), ("max", "max"), ("min", "min"))])
    numeric = named_columns(catalog.columns.filter("column_type = 'number'"), mode).select("*", F.explode(ops).alias("o")).select(
        "db_id", "source", F.concat_ws("_", "o.p", "dimension").alias("measure"), F.col("o.op").alias("op"), "column_name")
    rows = catalog.tables.select("db_id", source_name(F.col("table_name"), mode).alias("source"), F.lit("row_count").alias("measure"),
                                 F.lit("count").alias("op"), F.lit(None).cast("string").alias("column_name"))
    return rows.unionByName(numeric)


def derive_joins(catalog: Catalog, mode: str = "compat", drop_duplicates: bool = False, composites: DataFrame | None = None) -> DataFrame:
    """One join per reference; self references are skipped. ``composites``, as ``composite_refs`` finds them, make one
    join of several pairs; its fields are joined by commas, which no field name has.

    A join takes the name of its target. It gets an alias from the referring column if the
    target is joined more than once, its name is taken by an earlier join, or by a column.
    An alias that is taken gets the next free number. The windows span the references of
    one table."""
    refs = catalog.refs.filter("src_idx <> dst_idx")
    if drop_duplicates:
        refs = refs.groupBy("db_id", "src_idx", "src_table", "src_column", "dst_idx", "dst_table", "dst_column").agg(F.min("ref_no").alias("ref_no"))
    for side in ("src", "dst"):
        column, raw = snake_case(F.col(f"{side}_column"), mode), F.col(f"{side}_column")
        renamed = (F.lower(column) != F.lower(raw)) | needs_quoting(raw)
        refs = refs.withColumn(f"{side}_snake", column).withColumn(f"{side}_field", F.when(renamed, column).otherwise(raw)).withColumn(
            f"{side}_source", source_name(F.col(f"{side}_table"), mode))
    if composites is not None:
        refs = _together(refs, composites)
    names = named_columns(catalog.columns, mode).groupBy("db_id", F.col("table_idx").alias("src_idx")).agg(F.collect_set("dimension").alias("taken"))
    refs = refs.join(names.hint("merge"), ["db_id", "src_idx"], "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    table = Window.partitionBy("db_id", "src_idx")
    refs = refs.withColumn("same_target", F.count("*").over(Window.partitionBy("db_id", "src_idx", "dst_idx"))).withColumn(
        "earlier", F.row_number().over(Window.partitionBy("db_id", "src_idx", "dst_source").orderBy("ref_no")) - 1)
    aliased = (F.col("same_target") > 1) | (F.col("earlier") > 0) | F.array_contains("taken", F.col("dst_source"))
    base = F.replace(F.replace("src_snake", F.lit("_id"), F.lit("")), F.lit("_val"), F.lit(""))
    base = F.when((base == "") | (base == F.col("dst_source")), F.lit("ref")).otherwise(base)
    refs = refs.withColumn("aliased", aliased).withColumn("alias", F.concat_ws("_", base, "dst_source"))
    # Names given without an alias are taken too.
    plain = F.collect_set(F.when(~F.col("aliased"), F.col("dst_source"))).over(table)
    refs = refs.withColumn("taken", F.array_union("taken", plain)).withColumn(
        "turn", F.row_number().over(Window.partitionBy("db_id", "src_idx", "aliased", "alias").orderBy("ref_no")))

    def numbered(i):
        return F.when(i == 1, F.col("alias")).otherwise(F.concat_ws("_", "alias", i.cast("string")))

    choices = F.transform(F.sequence(F.lit(1), F.col("turn") + F.size("taken")), numbered)
    free = F.filter(choices, lambda name: ~F.array_contains("taken", name))
    name = F.when(F.col("aliased"), F.element_at(free, F.col("turn"))).otherwise(F.col("dst_source"))
    return refs.select("db_id", F.col("src_source").alias("source"), "ref_no", name.alias("join_name"), F.col("dst_source").alias("target"),
                       F.col("src_field").alias("field"), F.col("dst_field").alias("target_field"))


def _together(refs: DataFrame, composites: DataFrame) -> DataFrame:
    """One row per reference: the pairs of a composite one in the order of the catalog, named by the first."""
    members = composites.select("db_id", F.array_min("refs").alias("lead"), F.explode("refs").alias("ref_no"))
    whole = refs.join(members.hint("merge"), ["db_id", "ref_no"], "left").withColumn("lead", F.coalesce("lead", "ref_no"))
    pair = F.struct("ref_no", "src_snake", "src_field", "dst_field")
    grouped = whole.groupBy("db_id", "src_idx", "src_source", "dst_idx", "dst_source", "lead").agg(F.sort_array(F.collect_list(pair)).alias("ps"))

    def listed(name: str) -> Column:
        return F.array_join(F.transform("ps", lambda p: p[name]), ",").alias(name)

    return grouped.select("db_id", "src_idx", "src_source", "dst_idx", "dst_source", F.col("lead").alias("ref_no"), F.get("ps", F.lit(0))["src_snake"].alias("src_snake"),
                          listed("src_field"), listed("dst_field"))


def dependency_levels(tables: DataFrame, refs: DataFrame) -> DataFrame:
    """``db_id, table_idx, level, cyclic``: a table comes after every table it refers to.

    All databases advance together: each round takes the tables whose references are all
    placed. The number of rounds is the longest chain. What is left when a round takes
    nothing lies on or behind a cycle and goes last in its database. Joins are sorted: a catalog unfolds its rows after the size
    that Spark knows, and a checkpoint keeps that size, so it would broadcast them all."""
    edges = cut_lineage(refs.filter("src_idx <> dst_idx").select("db_id", "src_idx", "dst_idx").distinct())
    left = cut_lineage(tables.select("db_id", "table_idx"))
    placed, level = left.limit(0).select("db_id", "table_idx", F.lit(0).alias("level")), 0
    while True:
        waiting = edges.select("db_id", F.col("src_idx").alias("table_idx"))
        ready = cut_lineage(left.join(waiting.hint("merge"), ["db_id", "table_idx"], "left_anti"))
        if ready.isEmpty():
            break
        placed = placed.union(ready.select("db_id", "table_idx", F.lit(level).alias("level")))
        left = cut_lineage(left.join(ready.hint("merge"), ["db_id", "table_idx"], "left_anti"))
        edges = cut_lineage(edges.join(ready.withColumnRenamed("table_idx", "dst_idx").hint("merge"), ["db_id", "dst_idx"], "left_anti"))
        level += 1
    last = placed.groupBy("db_id").agg((F.max("level") + 1).alias("last"))
    cyclic = left.join(last.hint("merge"), "db_id", "left").select("db_id", "table_idx", F.coalesce("last", F.lit(0)).alias("level"), F.lit(True).alias("cyclic"))
    return placed.withColumn("cyclic", F.lit(False)).union(cyclic)


def derive_sources(catalog: Catalog, mode: str = "compat") -> DataFrame:
    fields = named_columns(catalog.columns, mode).select("db_id", "col_idx", "field")
    keys = catalog.keys.join(fields.hint("merge"), ["db_id", "col_idx"]).groupBy("db_id", "table_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key_no", "field"))), lambda k: k["field"]).alias("primary_key"))
    levels = dependency_levels(catalog.tables, catalog.refs)
    return (catalog.tables.join(keys.hint("merge"), ["db_id", "table_idx"], "left").join(levels.hint("merge"), ["db_id", "table_idx"])
            .select("db_id", source_name(F.col("table_name"), mode).alias("source"), "table_name",
                    F.coalesce("primary_key", F.array().cast("array<string>")).alias("primary_key"), "level", "cyclic"))


def derive_model(catalog: Catalog, mode: str = "compat", drop_duplicates: bool = False, composites: DataFrame | None = None) -> ModelTables:
    return ModelTables(derive_sources(catalog, mode), derive_dimensions(catalog.columns, mode),
                       derive_measures(catalog, mode), derive_joins(catalog, mode, drop_duplicates, composites))


def measure_warnings(catalog: Catalog, mode: str = "compat") -> DataFrame:
    """``db_id, source, column_name, reason`` for numeric columns whose sum or average means
    nothing: keys, references, and codes by their name."""
    numeric = named_columns(catalog.columns.filter("column_type = 'number'"), mode)
    keys = catalog.keys.select("db_id", "col_idx").distinct().withColumn("is_key", F.lit(True))
    refs = catalog.refs.select("db_id", F.col("src_idx").alias("table_idx"), F.col("src_column").alias("column_name")).distinct().withColumn("is_ref", F.lit(True))
    code = F.col("dimension").rlike(r"(^|_)(i_?d|zip|zip_?code|phone|telephone|fax|code|number|year|ssn)(_val)?$")
    reason = (F.when(F.col("is_key"), "key").when(F.col("is_ref"), "reference").when(code, "code"))
    return (numeric.join(keys, ["db_id", "col_idx"], "left").join(refs, ["db_id", "table_idx", "column_name"], "left")
            .select("db_id", "source", "column_name", reason.alias("reason")).filter("reason is not null"))


def tables_of_model(spark: SparkSession, model: Model, db_id: str) -> ModelTables:
    """A model declared by hand in the same four relations, for coverage counts and for storage."""
    sources, dims, measures, joins = [], [], [], []
    for s in model.sources.values():
        sources.append((db_id, s.name, s.name, list(s.primary_key), None, None))
        dims += [(db_id, s.name, d.name, d.expr, d.expr.startswith("`")) for d in s.dimensions]
        measures += [(db_id, s.name, m.name, m.op, m.expr) for m in s.measures]
        joins += [(db_id, s.name, i, j.name, j.target, ",".join(a for a, _ in pairs), ",".join(b for _, b in pairs))
                  for i, j in enumerate(s.joins) for pairs in [model.join_keys(s, j)]]
    return ModelTables(
        spark.createDataFrame(sources, "db_id string, source string, table_name string, primary_key array<string>, level int, cyclic boolean"),
        spark.createDataFrame(dims, "db_id string, source string, dimension string, column_name string, needs_quoting boolean"),
        spark.createDataFrame(measures, "db_id string, source string, measure string, op string, column_name string"),
        spark.createDataFrame(joins, "db_id string, source string, ref_no int, join_name string, target string, field string, target_field string"))


def build_model(tables: ModelTables, db_id: str, frames: dict[str, DataFrame]) -> Model:
    """Model objects of one database over its DataFrames (by table name); what is read to the
    driver is the declaration of that database, not data."""
    mine = [df.filter(F.col("db_id") == db_id).collect() for df in (tables.sources, tables.dimensions, tables.measures, tables.joins)]
    sources, dims, measures, joins = mine

    def of(rows, name):
        return [r for r in rows if r["source"] == name]

    return Model.build(*[Source.of(s["source"], frames[s["table_name"]]).extend(
        dimensions=[rename(d["dimension"], d["column_name"]) for d in of(dims, s["source"])],
        measures=[Measure(m["measure"], m["op"], None if m["column_name"] is None else quoted(m["column_name"])) for m in of(measures, s["source"])],
        primary_key=s["primary_key"],
        joins=[Join(j["join_name"], j["target"], tuple(zip(j["field"].split(","), j["target_field"].split(",")))) for j in of(joins, s["source"])]) for s in sources])
