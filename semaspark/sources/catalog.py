"""Table catalogs: what tables, columns, keys and references each database declares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.functions.naming import INTERNAL_TABLES


@dataclass(frozen=True)
class Catalog:
    """Four relations, all keyed by ``db_id``.

    tables   db_id, table_idx, table_name
    columns  db_id, table_idx, table_name, col_idx, column_name, column_type
    keys     db_id, table_idx, table_name, key_no, col_idx, column_name
    refs     db_id, ref_no, src_idx, src_table, src_column, dst_idx, dst_table, dst_column
    """

    tables: DataFrame
    columns: DataFrame
    keys: DataFrame
    refs: DataFrame

    def last_key_column(self) -> DataFrame:
        """One key column per table, the last declared: what a single-column key model keeps."""
        return (self.keys.groupBy("db_id", "table_idx", "table_name")
                .agg(F.max_by("column_name", "key_no").alias("column_name")))


RAW_SCHEMA = ("db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
              "column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>")


def read_catalog(spark: SparkSession, path: str, multi_line: bool = True) -> Catalog:
    """JSON with one object per database and parallel arrays inside."""
    return load_catalog(raw_catalog(spark.read.schema(RAW_SCHEMA).json(path, multiLine=multi_line)))


def raw_catalog(raw: DataFrame) -> DataFrame:
    """Turns the two-element arrays of the JSON form into named fields."""
    pairs = F.transform("column_names_original", lambda c: F.struct(c[0].cast("int").alias("table_idx"), c[1].alias("name")))
    refs = F.transform(F.filter("foreign_keys", lambda k: F.size(k) == 2), lambda k: F.struct(k[0].alias("fk"), k[1].alias("pk")))
    return raw.withColumn("column_names_original", pairs).withColumn("foreign_keys", refs)


def load_catalog(raw: DataFrame) -> Catalog:
    """Catalog relations from nested rows.

    A key or reference is an index into an array of its own row, so it is resolved there:
    loading is a projection, without a join or a shuffle."""
    tables = raw.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table_name"))

    def table_of(column: Column) -> Column:
        return F.get("table_names_original", column["table_idx"])

    def column_at(index: Column) -> Column:
        return F.get("column_names_original", index)

    columns = raw.select("*", F.posexplode("column_names_original").alias("col_idx", "c")).select(
        "db_id", F.col("c.table_idx").alias("table_idx"), table_of(F.col("c")).alias("table_name"), "col_idx",
        F.col("c.name").alias("column_name"),
        F.coalesce(F.get("column_types", F.col("col_idx")), F.lit("text")).alias("column_type"))
    keys = raw.select("*", F.posexplode("primary_keys").alias("key_no", "col_idx")).withColumn("c", column_at(F.col("col_idx"))).select(
        "db_id", F.col("c.table_idx").alias("table_idx"), table_of(F.col("c")).alias("table_name"), "key_no", "col_idx",
        F.col("c.name").alias("column_name"))
    refs = (raw.select("*", F.posexplode("foreign_keys").alias("ref_no", "k"))
            .withColumn("s", column_at(F.col("k.fk"))).withColumn("d", column_at(F.col("k.pk"))).select(
                "db_id", "ref_no", F.col("s.table_idx").alias("src_idx"), table_of(F.col("s")).alias("src_table"),
                F.col("s.name").alias("src_column"), F.col("d.table_idx").alias("dst_idx"), table_of(F.col("d")).alias("dst_table"),
                F.col("d.name").alias("dst_column")))
    return Catalog(
        tables.filter(_listed("table_name")), columns.filter(_real("table_idx", "table_name")),
        keys.filter(_real("table_idx", "table_name")),
        refs.filter(_real("src_idx", "src_table") & _real("dst_idx", "dst_table")))


def _listed(name: str) -> Column:
    return ~F.lower(name).isin(*INTERNAL_TABLES)


def _real(idx: str, name: str) -> Column:
    """Leaves out the ``*`` column, whose table index is negative, and internal tables."""
    return (F.col(idx) >= 0) & F.col(name).isNotNull() & _listed(name)


def type_label(dtype: T.DataType) -> str:
    return "number" if isinstance(dtype, T.NumericType) else "text"


def catalog_from_frames(spark: SparkSession, frames: dict[str, DataFrame], db_id: str = "db",
                        keys: dict[str, list[str]] | None = None,
                        refs: list[tuple[str, str, str, str]] = ()) -> Catalog:
    """The catalog of live DataFrames: names and types come from their schemas; keys and
    references (table, column, table, column) are declared by the caller."""
    order = {name: i for i, name in enumerate(frames)}
    columns, at = [], {}
    for name, df in frames.items():
        for f in df.schema.fields:
            at[name, f.name] = len(columns)
            columns.append((db_id, order[name], name, len(columns), f.name, type_label(f.dataType)))
    declared = [(db_id, order[t], t, i, at[t, c], c) for t, cols in (keys or {}).items() for i, c in enumerate(cols)]
    links = [(db_id, i, order[s], s, sc, order[d], d, dc) for i, (s, sc, d, dc) in enumerate(refs)]
    return Catalog(
        spark.createDataFrame([(db_id, i, n) for n, i in order.items()], "db_id string, table_idx int, table_name string"),
        spark.createDataFrame(columns, "db_id string, table_idx int, table_name string, col_idx int, column_name string, column_type string"),
        spark.createDataFrame(declared, "db_id string, table_idx int, table_name string, key_no int, col_idx int, column_name string"),
        spark.createDataFrame(links, "db_id string, ref_no int, src_idx int, src_table string, src_column string, "
                                     "dst_idx int, dst_table string, dst_column string"))


def render_schema(catalog: Catalog) -> DataFrame:
    """``db_id, schema_text``: tables with typed columns, then keys, then references.

    The text is one row per database by nature; only names are gathered for it."""
    per_table = catalog.columns.groupBy("db_id", "table_idx").agg(F.array_sort(F.collect_list(F.struct(
        "col_idx", F.concat(F.lit("  - "), "column_name", F.lit(" ("), "column_type", F.lit(")")).alias("line")))).alias("cs"))
    blocks = catalog.tables.join(per_table, ["db_id", "table_idx"], "left").select("db_id", F.struct("table_idx", F.concat_ws(
        "\n", F.concat(F.lit("Table: "), "table_name"), F.transform("cs", lambda c: c["line"]), F.lit("")).alias("line")).alias("b"))
    keys = _lines(catalog.keys.select("db_id", F.struct(F.col("key_no"), F.concat(
        F.lit("  - "), "table_name", F.lit("."), "column_name").alias("line")).alias("b")), "keys")
    refs = _lines(catalog.refs.select("db_id", F.struct(F.col("ref_no"), F.concat(
        F.lit("  - "), "src_table", F.lit("."), "src_column", F.lit(" -> "), "dst_table", F.lit("."), "dst_column").alias("line")).alias("b")), "refs")
    whole = _lines(blocks, "tables").join(keys, "db_id", "left").join(refs, "db_id", "left")
    return whole.select("db_id", F.concat_ws(
        "\n", F.concat(F.lit("Database: "), "db_id"), F.lit(""), "tables",
        F.when(F.col("keys").isNotNull(), F.concat(F.lit("Primary Keys:\n"), "keys", F.lit("\n"))),
        F.when(F.col("refs").isNotNull(), F.concat(F.lit("Foreign Keys:\n"), "refs"))).alias("schema_text"))


def _lines(df: DataFrame, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list("b"))
    return df.groupBy("db_id").agg(F.array_join(F.transform(ordered, lambda b: b["line"]), "\n").alias(name))
