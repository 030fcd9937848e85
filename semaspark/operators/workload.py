"""Mine query logs: the tables, columns, aggregates and joins each database is asked for.

Equal texts are merged first. The names of a database are one nested row, which meets each of its texts once; what a text names is then
decided inside its row: one-word names among the words of the text, other names ("home town", "%_change") by a pattern on it.
All reports are sums over the same facts, so a log is read once whatever is asked of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaspark.functions.scopes import equalities
from semaspark.session import BROADCAST_ROWS, cut_lineage
from semaspark.sources.catalog import Catalog

# The aggregates a log is searched for.
AGGREGATES = ("count", "sum", "avg", "min", "max")

SALTS = 32

_WORD = r"(?U)\w+"


def distinct_queries(log: DataFrame) -> DataFrame:
    """``db_id, query_id, sql, words, copies``: lower-cased texts, once each, with their words."""
    texts = log.select("db_id", F.lower("query").alias("sql")).groupBy("db_id", "sql").agg(F.count("*").alias("copies"))
    return texts.select("db_id", F.md5("sql").alias("query_id"), "sql", _words(F.col("sql")).alias("words"), "copies")


def _words(text: Column) -> Column:
    """Distinct words. Unicode word rules cost several times the plain ones, so only text that
    has other than ASCII characters pays for them."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_distinct(F.when(plain, F.regexp_extract_all(text, F.lit(r"\w+"), 0)).otherwise(F.regexp_extract_all(text, F.lit(_WORD), 0)))


def whole_word(name: Column) -> Column:
    """A pattern for ``name`` as a whole word, whatever characters it has."""
    literal = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?U)\\b\\Q"), literal, F.lit("\\E\\b"))


def _odd(name: Column) -> Column:
    """Whether the name is not one word."""
    return F.regexp_extract(name, _WORD, 0) != name


def name_tables(catalog: Catalog) -> tuple[DataFrame, bool]:
    """One row per database: its tables with their columns, in lower case; and whether all of it may be sent to every
    executor. A row is as large as a schema."""
    lower = lambda c: F.lower(c).alias(c)
    columns = catalog.columns.select("db_id", lower("table_name"), lower("column_name")).distinct()
    column = F.struct(F.col("column_name").alias("name"), _odd(F.col("column_name")).alias("odd"))
    listed = columns.groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    tables = catalog.tables.select("db_id", lower("table_name")).distinct().join(listed, ["db_id", "table_name"], "left")
    none = F.array().cast("array<struct<name: string, odd: boolean>>")
    table = F.struct(F.col("table_name").alias("name"), _odd(F.col("table_name")).alias("odd"), F.coalesce("columns", none).alias("columns"))
    names = cut_lineage(tables.groupBy("db_id").agg(F.sort_array(F.collect_list(table)).alias("names"), F.sum(F.size(F.coalesce("columns", none)) + 1).alias("size")))
    total = names.agg(F.sum("size")).first()[0] or 0
    return names.drop("size"), total <= BROADCAST_ROWS


def _with_names(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """Each query with the names of its database; queries without a catalog drop out. Beyond what may be
    sent to every executor, a busy database is dealt over ``SALTS`` tasks and both sides are sorted: the size that Spark
    estimates knows nothing of the names in a row nor of the salts, so it would broadcast them all."""
    names, small = name_tables(catalog)
    if small:
        return queries.join(F.broadcast(names), "db_id")
    left = queries.withColumn("__salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    salted = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(salted.hint("merge"), ["db_id", "__salt"]).drop("__salt")


def _calls() -> Column:
    """For each aggregate that is called the words inside its calls, up to the first closing parenthesis."""
    called = F.array(*[F.struct(F.lit(a).alias("agg"), F.regexp_extract_all("sql", F.lit(rf"{a}\s*\(([^)]*)"), 1).alias("args")) for a in AGGREGATES])
    return F.transform(F.filter(called, lambda x: F.size(x["args"]) > 0),
                       lambda x: F.struct(x["agg"].alias("agg"), F.array_distinct(F.flatten(F.transform(x["args"], _words))).alias("words")))


def mine(queries: DataFrame, catalog: Catalog) -> DataFrame:
    """``db_id, query_id, copies`` and what each query names: ``tables``, ``columns`` (table_name, column_name) of tables it names,
    ``calls`` (table_name, agg, column_name) and ``joins`` between tables of its database.

    One-word names are words of the text, other names are looked for in it. All of it is decided in the row of the query, so
    the log is read once and a text moves once, to meet the names of its database."""
    def named(x: Column) -> Column:
        return F.when(x["odd"], F.regexp_like("sql", whole_word(x["name"]))).otherwise(F.array_contains("words", x["name"]))

    def called(call: Column, c: Column) -> Column:
        body = F.regexp_replace(whole_word(c["name"]), r"^\(\?U\)", "")
        inside = F.regexp_like("sql", F.concat(F.lit("(?U)"), call["agg"], F.lit(r"\s*\([^)]*"), body))
        return F.when(c["odd"], inside).otherwise(F.array_contains(call["words"], c["name"]))

    rows = _with_names(queries, catalog).withColumn("calls", _calls())
    rows = rows.withColumn("used", F.transform(F.filter("names", named), lambda t: F.struct(t["name"].alias("name"), F.filter(t["columns"], named).alias("columns"))))
    columns = F.flatten(F.transform("used", lambda t: F.transform(t["columns"], lambda c: F.struct(t["name"].alias("table_name"), c["name"].alias("column_name")))))
    calls = F.flatten(F.flatten(F.transform("used", lambda t: F.transform("calls", lambda x: F.transform(
        F.filter(t["columns"], lambda c: called(x, c)), lambda c: F.struct(t["name"].alias("table_name"), x["agg"].alias("agg"), c["name"].alias("column_name")))))))
    return rows.select("db_id", "query_id", "copies", F.transform("used", lambda t: t["name"]).alias("tables"), columns.alias("columns"), calls.alias("calls"),
                       F.filter(_equalities(), lambda j: F.exists("names", lambda t: t["name"] == j["left_table"]) & F.exists("names", lambda t: t["name"] == j["right_table"])).alias("joins"))


def _equalities() -> Column:
    """Equalities between two qualified columns of the text, smaller table name first."""
    pattern = F.lit(r"(?U)(\w+)\s*\.\s*(\w+)\s*=\s*(\w+)\s*\.\s*(\w+)")
    pieces = F.arrays_zip(*[F.regexp_extract_all("sql", pattern, i).alias(n) for i, n in enumerate(("t1", "c1", "t2", "c2"), 1)])

    def sides(m: Column) -> Column:
        swap = m["t1"] > m["t2"]
        return F.struct(*[F.when(swap, m[y]).otherwise(m[x]).alias(n) for x, y, n in (
            ("t1", "t2", "left_table"), ("c1", "c2", "left_col"), ("t2", "t1", "right_table"), ("c2", "c1", "right_col"))])

    return F.array_distinct(F.transform(pieces, sides))


def _hits(queries: DataFrame, catalog: Catalog, what: str) -> DataFrame:
    # The outer form, because Spark tests beforehand whether a plain explode has anything, which decides all names of a text twice.
    return mine(queries, catalog).select("db_id", F.explode_outer(what).alias("x")).filter("x is not null").distinct()


def tables_used(queries: DataFrame, catalog: Catalog) -> DataFrame:
    return _hits(queries, catalog, "tables").select("db_id", F.col("x").alias("table_name"))


def columns_used(queries: DataFrame, catalog: Catalog) -> DataFrame:
    return _hits(queries, catalog, "columns").select("db_id", "x.*")


def aggregates_used(queries: DataFrame, catalog: Catalog) -> DataFrame:
    return _hits(queries, catalog, "calls").select("db_id", "x.table_name", "x.agg", "x.column_name")


def joins_used(queries: DataFrame, catalog: Catalog, resolve_aliases: bool = False) -> DataFrame:
    """``db_id, left_table, left_col, right_table, right_col``: equalities between two tables,
    smaller table name first. Without alias resolution both sides must be table names.

    Aliases mean what the nearest scope of the same text binds them to, so this stays inside the row."""
    if not resolve_aliases:
        return _hits(queries, catalog, "joins").select("db_id", "x.*")
    # Only texts with both signs can have one. The outer form reads the tokens of a text once; a plain explode is tested beforehand.
    found = queries.filter(F.col("sql").contains("=") & F.col("sql").contains(".")).select("db_id", F.explode_outer(equalities(F.col("sql"))).alias("m")).filter("m is not null")
    found = found.select("db_id", F.explode("m.t1").alias("t1"), "m.c1", F.col("m.t2").alias("others"), "m.c2")
    found = found.select("db_id", "t1", "c1", F.explode("others").alias("t2"), "c2")
    swap = F.col("t1") > F.col("t2")
    sides = found.select("db_id", *[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for x, y, n in (
        ("t1", "t2", "left_table"), ("c1", "c2", "left_col"), ("t2", "t1", "right_table"), ("c2", "c1", "right_col"))]).distinct()
    names = catalog.tables.select("db_id", F.lower("table_name").alias("name")).distinct()
    for side in ("left_table", "right_table"):
        sides = sides.join(names.withColumnRenamed("name", side), ["db_id", side], "left_semi")
    return sides.select("db_id", "left_table", "left_col", "right_table", "right_col")


FACT = "struct<kind: string, a: string, b: string, c: string, d: string>"


def facts(log: DataFrame, catalog: Catalog) -> DataFrame:
    """``db_id, kind, a, b, c, d, n``: everything a log says, once per database, with the number of queries that say it. Kinds:
    query, table (a), column (a of table, b), call (a table, b aggregate, c column), join (tables a and c by columns b and d)."""
    def fact(kind: str, *parts: Column) -> Column:
        filled = [*parts, *[F.lit(None).cast("string")] * (4 - len(parts))]
        return F.struct(F.lit(kind).alias("kind"), *[p.alias(n) for p, n in zip(filled, "abcd")]).cast(FACT)

    said = F.concat(
        F.array(fact("query")), F.transform("tables", lambda t: fact("table", t)), F.transform("columns", lambda c: fact("column", c["table_name"], c["column_name"])),
        F.transform("calls", lambda c: fact("call", c["table_name"], c["agg"], c["column_name"])),
        F.transform("joins", lambda j: fact("join", j["left_table"], j["left_col"], j["right_table"], j["right_col"])))
    each = mine(distinct_queries(log), catalog).select("db_id", "copies", F.explode_outer(said).alias("f")).filter("f is not null").select("db_id", "copies", "f.*")
    return each.groupBy("db_id", "kind", "a", "b", "c", "d").agg(F.sum("copies").alias("n"))


def analysis_report(log: DataFrame, catalog: Catalog) -> DataFrame:
    """One nested row per database of the log that has a catalog: ``query_count, tables_used,
    dimensions, measures, joins``. Lists hold distinct names, so a row is as large as a schema."""
    def of(kind: str, value: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))

    each = facts(log, catalog).groupBy("db_id", "kind", "a", F.when(F.col("kind") == "call", F.col("b")).alias("agg"),
                                       F.when(F.col("kind") == "join", F.struct("b", "c", "d")).alias("on")).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("kind") == "call", F.col("c")).otherwise(F.col("b")))).alias("columns"))
    report = each.groupBy("db_id").agg(
        F.sum(F.when(F.col("kind") == "query", F.col("n"))).alias("query_count"), of("table", F.col("a")).alias("tables_used"),
        of("column", F.struct(F.col("a").alias("table_name"), "columns")).alias("dimensions"),
        of("call", F.struct(F.col("a").alias("table_name"), "agg", "columns")).alias("measures"),
        of("join", F.struct(F.col("a").alias("left_table"), F.col("on.b").alias("left_col"), F.col("on.c").alias("right_table"), F.col("on.d").alias("right_col"))).alias("joins"))
    lists = ("tables_used", "dimensions", "measures", "joins")
    return report.select("db_id", "query_count", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in lists])


def derive_minimal(log: DataFrame, catalog: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, dimensions and measures that the log uses, and no others.

    ``row_count`` is there for every used table with a used column; other measures are those
    observed, named ``<agg>_<column>``."""
    said = cut_lineage(facts(log, catalog).filter("kind in ('table', 'column', 'call')").select("db_id", "kind", F.col("a").alias("source"), "b", "c"))
    sources = said.filter("kind = 'table'").select("db_id", "source")
    original = catalog.columns.select("db_id", F.lower("table_name").alias("source"), F.lower("column_name").alias("dimension"), "column_name")
    used = said.filter("kind = 'column'").select("db_id", "source", F.col("b").alias("dimension"))
    # Sorted, as in ``_with_names``: a catalog unfolds its rows after the size that Spark knows.
    dimensions = used.join(original.hint("merge"), ["db_id", "source", "dimension"]).select("db_id", "source", "dimension", "column_name")
    observed = said.filter("kind = 'call'").select("db_id", "source", F.concat_ws("_", "b", "c").alias("measure"), F.col("b").alias("op"), F.col("c").alias("column_name"))
    rows = dimensions.select("db_id", "source").distinct().select(
        "db_id", "source", F.lit("row_count").alias("measure"), F.lit("count").alias("op"), F.lit(None).cast("string").alias("column_name"))
    return sources, dimensions, rows.unionByName(observed)


def log_summary(log: DataFrame, catalog: Catalog) -> DataFrame:
    """``databases_processed, databases_skipped, total_queries``; only processed databases count."""
    per_db = log.groupBy("db_id").agg(F.count("*").alias("n"))
    known = catalog.tables.select("db_id").distinct().withColumn("known", F.lit(True))
    return per_db.join(known, "db_id", "left").agg(
        F.count_if("known").alias("databases_processed"), F.count_if(F.col("known").isNull()).alias("databases_skipped"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("total_queries"))
