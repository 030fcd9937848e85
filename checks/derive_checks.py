"""Catalogs, derivation, log mining, audits and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import (CATALOG_SQL, LOG_SQL, catalogs, log_catalog, query_log, raw_catalogs, sql_clean,
                            sql_quoting, sql_snake)
from checks.registry import query, table
from semaspark.functions import naming as N
from semaspark.operators import audit as V
from semaspark.operators import composite as K
from semaspark.operators import coverage as C
from semaspark.operators import derive as D
from semaspark.operators import workload as W
from semaspark.plans.model import Measure, Model, dim
from semaspark.plans.query import run
from semaspark.plans.tpch import TABLES, sales_model
from semaspark.session import staging_path
from semaspark.sources.catalog import catalog_from_frames, read_catalog
from semaspark.sources.records import load_questions, read_envelope


@query("s3_catalog_load", CATALOG_SQL + "SELECT db_id, 'column' AS kind, col_idx AS no, table_name || '.' || column_name || ' ' || column_type AS what FROM cat_columns "
       "UNION ALL SELECT db_id, 'key', key_no, table_name || '.' || column_name FROM cat_keys "
       "UNION ALL SELECT db_id, 'ref', ref_no, src_table || '.' || src_column || ' -> ' || dst_table || '.' || dst_column FROM cat_refs")
def s3(spark, sf):
    path = staging_path(spark, "catalog")
    raw_catalogs(spark, sf).write.json(path)
    c = read_catalog(spark, path, multi_line=False)
    name = F.concat_ws(".", "table_name", "column_name")
    columns = c.columns.select("db_id", F.lit("column").alias("kind"), F.col("col_idx").alias("no"), F.concat_ws(" ", name, "column_type").alias("what"))
    keys = c.keys.select("db_id", F.lit("key"), "key_no", name)
    refs = c.refs.select("db_id", F.lit("ref"), "ref_no", F.concat_ws(" -> ", F.concat_ws(".", "src_table", "src_column"), F.concat_ws(".", "dst_table", "dst_column")))
    return columns.union(keys).union(refs)


@query("s4_live_catalog", " UNION ALL ".join(
    f"SELECT '{t}' AS source, (SELECT COUNT(*) FROM (DESCRIBE {t})) AS n_columns, (SELECT COUNT(*) FROM {t}) AS row_count" for t in TABLES))
def s4(spark, sf):
    frames = {t: table(spark, sf, t) for t in TABLES}
    live = catalog_from_frames(spark, frames, "sales")
    model = D.build_model(D.derive_model(live), "sales", frames)
    counts = V.smoke_count(model)
    per_table = live.columns.groupBy(F.col("table_name")).agg(F.count("*").alias("n_columns"))
    named = live.tables.select("table_name", N.source_name(F.col("table_name")).alias("source"))
    return named.join(counts, "source").join(per_table, "table_name").select(F.col("table_name").alias("source"), "n_columns", "row_count")


@query("s5_question_files", "SELECT 'db_' || conv_id AS db_id, text AS question, role AS source FROM conversations")
def s5(spark, sf):
    base = staging_path(spark, "questions")
    talk = table(spark, sf, "conversations").select(F.concat(F.lit("db_"), "conv_id").alias("db_id"), F.col("text").alias("question"), "role")
    talk.write.partitionBy("role").json(base)
    roles = [r["role"] for r in talk.select("role").distinct().collect()]  # a handful of names
    return load_questions(spark, {r: f"{base}/role={r}" for r in roles}, multi_line=False).select("db_id", "question", "source")


@query("s6_envelope", "SELECT event_id AS question_id, event_type AS provider FROM events UNION ALL SELECT -event_id - 1, props FROM events")
def s6(spark, sf):
    path = staging_path(spark, "envelope")
    record = lambda i, p: F.struct(i.alias("question_id"), p.alias("provider"))
    table(spark, sf, "events").select(F.struct(F.col("ts").cast("string").alias("created")).alias("metadata"), F.array(
        record(F.col("event_id"), F.col("event_type")), record(-F.col("event_id") - 1, F.col("props"))).alias("results")).write.json(path)
    return read_envelope(spark, path, "results", "question_id: bigint, provider: string", multi_line=False)


@query("s8_model_sink", CATALOG_SQL + "SELECT 'sources' AS kind, COUNT(*) AS n FROM cat_tables UNION ALL "
       f"SELECT 'dimensions', COUNT(*) FROM cat_columns WHERE lower({sql_snake('column_name')}) <> lower(column_name) OR {sql_quoting('column_name')} UNION ALL "
       "SELECT 'measures', (SELECT COUNT(*) FROM cat_tables) + 4 * COUNT(*) FROM cat_columns WHERE column_type = 'number' UNION ALL "
       "SELECT 'joins', COUNT(*) FROM cat_refs WHERE src_idx <> dst_idx")
def s8(spark, sf):
    path = staging_path(spark, "model")
    D.derive_model(catalogs(spark, sf)).write(path)
    model = D.ModelTables.read(spark, path)
    frames = [getattr(model, k).select(F.lit(k).alias("kind")) for k in ("sources", "dimensions", "measures", "joins")]
    every = frames[0].union(frames[1]).union(frames[2]).union(frames[3])
    return every.groupBy("kind").agg(F.count("*").alias("n"))


RAW_NAME = ("CASE p_size % 6 WHEN 0 THEN p_name || ' (' || p_brand || ')-' || p_type WHEN 1 THEN p_type || p_partkey || 'Total%' WHEN 2 THEN 'Year' "
            "WHEN 3 THEN p_size || '_' || p_brand || '.Rating/Share' WHEN 4 THEN 'GNPOld' || p_brand ELSE '' || p_name END")
WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM documents"


def _names(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    return table(spark, sf, "part").select(F.expr(RAW_NAME).alias("name")).union(words)


NAMES_SQL = f"WITH names AS (SELECT {RAW_NAME} AS name FROM part UNION ALL {WORDS}) "


@query("a1_clean_identifier", NAMES_SQL + f"SELECT name, {sql_clean('name')} AS clean FROM names")
def a1(spark, sf):
    return _names(spark, sf).select("name", N.clean_identifier(F.col("name")).alias("clean"))


@query("a2_snake_case", NAMES_SQL + f"SELECT name, {sql_snake('name')} AS snake, {sql_snake('name', True)} AS acronym FROM names")
def a2(spark, sf):
    return _names(spark, sf).select("name", N.snake_case(F.col("name")).alias("snake"), N.snake_case(F.col("name"), "acronym").alias("acronym"))


@query("a3_quoting", NAMES_SQL + f"SELECT name, {sql_quoting('name')} AS quoting FROM names")
def a3(spark, sf):
    return _names(spark, sf).select("name", N.needs_quoting(F.col("name")).alias("quoting"))


@query("a4_source_name", CATALOG_SQL + f"SELECT db_id, table_name, {sql_snake('table_name')} AS source FROM cat_tables")
def a4(spark, sf):
    return catalogs(spark, sf).tables.select("db_id", "table_name", N.source_name(F.col("table_name")).alias("source"))


@query("a5_internal_tables", CATALOG_SQL + "SELECT db_id, COUNT(*) AS tables FROM cat_tables GROUP BY db_id")
def a5(spark, sf):
    return catalogs(spark, sf).tables.groupBy("db_id").agg(F.count("*").alias("tables"))


@query("a6_columns", CATALOG_SQL + "SELECT db_id, table_name, col_idx, column_name, column_type FROM cat_columns")
def a6(spark, sf):
    return catalogs(spark, sf).columns.select("db_id", "table_name", "col_idx", "column_name", "column_type")


@query("a7_primary_keys", CATALOG_SQL + "SELECT db_id, table_name, string_agg(column_name, ',' ORDER BY key_no) AS key, arg_max(column_name, key_no) AS last "
       "FROM cat_keys GROUP BY db_id, table_name")
def a7(spark, sf):
    c = catalogs(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("key_no", "column_name")))
    whole = c.keys.groupBy("db_id", "table_idx", "table_name").agg(F.array_join(F.transform(ordered, lambda k: k["column_name"]), ",").alias("key"))
    last = c.last_key_column().withColumnRenamed("column_name", "last")
    return whole.join(last, ["db_id", "table_idx", "table_name"]).select("db_id", "table_name", "key", "last")


@query("a8_foreign_keys", CATALOG_SQL + "SELECT db_id, ref_no, src_table, src_column, dst_table, dst_column FROM cat_refs")
def a8(spark, sf):
    return catalogs(spark, sf).refs.select("db_id", "ref_no", "src_table", "src_column", "dst_table", "dst_column")


LEVELS_SQL = ("WITH RECURSIVE " + CATALOG_SQL.removeprefix("WITH ") + """, walk(db_id, table_idx, here, depth) AS (
  SELECT db_id, table_idx, table_idx, 0 FROM cat_tables UNION
  SELECT w.db_id, w.table_idx, r.dst_idx, depth + 1 FROM walk w JOIN cat_refs r ON r.db_id = w.db_id AND r.src_idx = w.here AND r.dst_idx <> r.src_idx WHERE depth < 12),
deep AS (SELECT db_id, table_idx, MAX(depth) AS level FROM walk GROUP BY 1, 2)
SELECT db_id, table_idx, level >= 12 AS cyclic, CASE WHEN level < 12 THEN level ELSE COALESCE(
  MAX(CASE WHEN level < 12 THEN level END) OVER (PARTITION BY db_id) + 1, 0) END AS level FROM deep""")


@query("a9_dependency_levels", LEVELS_SQL)
def a9(spark, sf):
    c = catalogs(spark, sf)
    return D.dependency_levels(c.tables, c.refs)


def _field(side: str) -> str:
    col = f"{side}_column"
    return f"CASE WHEN lower({sql_snake(col)}) <> lower({col}) OR {sql_quoting(col)} THEN {sql_snake(col)} ELSE {col} END"


def joins_sql(refs: str) -> str:
    return f"""{CATALOG_SQL}, refs AS (SELECT *, {sql_snake('src_table')} AS source, {sql_snake('dst_table')} AS target, {sql_snake('src_column')} AS snake,
  {_field('src')} AS field, {_field('dst')} AS target_field FROM ({refs}) t WHERE src_idx <> dst_idx),
taken AS (SELECT DISTINCT db_id, table_idx AS src_idx, {sql_snake('column_name')} AS target FROM cat_columns),
a AS (SELECT refs.*, COUNT(*) OVER (PARTITION BY db_id, src_idx, dst_idx) > 1
  OR (db_id, src_idx, target) IN (SELECT (db_id, src_idx, target) FROM taken) AS aliased,
  replace(replace(snake, '_id', ''), '_val', '') AS base FROM refs),
b AS (SELECT *, (CASE WHEN base IN ('', target) THEN 'ref' ELSE base END) || '_' || target AS alias FROM a),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY db_id, src_idx, aliased, alias ORDER BY ref_no) AS turn FROM b)
SELECT db_id, source, ref_no, CASE WHEN NOT aliased THEN target WHEN turn = 1 THEN alias ELSE alias || '_' || turn END AS join_name,
  target, field, target_field FROM c"""


@query("a10_a11_joins_and_aliases", joins_sql("SELECT * FROM cat_refs"))
def a10(spark, sf):
    return D.derive_joins(catalogs(spark, sf))


ONE_LINE = "(SELECT l_orderkey, l_linenumber, MIN(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"
CLAIMS = """SELECT l_orderkey AS first_order, l_linenumber AS first_line, x.o AS last_order, x.n AS last_line, l_quantity AS amount FROM lineitem,
  (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) x"""


def _claims(spark, sf):
    """Claims refer to a line twice, each time by order and number; the catalog lists four single pairs."""
    lines = table(spark, sf, "lineitem")
    last = lines.agg(F.max(F.struct("l_orderkey", "l_linenumber")).alias("m")).first()["m"]
    claims = lines.select(F.col("l_orderkey").alias("first_order"), F.col("l_linenumber").alias("first_line"), F.lit(last["l_orderkey"]).alias("last_order"),
                          F.lit(last["l_linenumber"]).alias("last_line"), F.col("l_quantity").alias("amount"))
    frames = {"line": lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")), "claim": claims}
    refs = [("claim", a, "line", b) for a, b in (("first_order", "l_orderkey"), ("last_line", "l_linenumber"), ("last_order", "l_orderkey"), ("first_line", "l_linenumber"))]
    catalog = catalog_from_frames(spark, frames, "db", {"line": ["l_linenumber"]}, refs)
    return frames, catalog, K.composite_refs(spark, catalog, lambda db, name: frames[name])


@query("a10_composite", f"WITH c AS ({CLAIMS}) SELECT CASE p WHEN 'first' THEN 'first_order_line' ELSE 'last_line_line' END AS join_name, p || '_order' AS one, p || '_line' AS two, COUNT(*) AS n_rows, COUNT(l.l_orderkey) AS n_found "
       "FROM c CROSS JOIN (VALUES ('first'), ('last')) r(p) LEFT JOIN " + ONE_LINE + " l ON l.l_orderkey = CASE p WHEN 'first' THEN first_order ELSE last_order END "
       "AND l.l_linenumber = CASE p WHEN 'first' THEN first_line ELSE last_line END GROUP BY p")
def a10_composite(spark, sf):
    _, catalog, found = _claims(spark, sf)
    joins = D.derive_joins(catalog, composites=found)
    field = F.array_sort(F.split("field", ","), lambda a, b: F.when(a.endswith("_order"), -1).otherwise(1))
    return joins.join(found, F.col("ref_no") == F.array_min("refs")).select("join_name", field[0].alias("one"), field[1].alias("two"), "n_rows", "n_found")


@query("m16_derived_composite", f"WITH c AS ({CLAIMS}) SELECT a.l_returnflag AS flag, COUNT(*) AS row_count, SUM(a.l_linenumber)::BIGINT AS numbers, SUM(b.l_linenumber)::BIGINT AS last_numbers FROM c "
       f"LEFT JOIN {ONE_LINE} a ON first_order = a.l_orderkey AND first_line = a.l_linenumber LEFT JOIN {ONE_LINE} b ON last_order = b.l_orderkey AND last_line = b.l_linenumber GROUP BY 1")
def m16_derived_composite(spark, sf):
    """The derived joins bring one line per claim each; single-column ones would multiply the claims."""
    frames, catalog, found = _claims(spark, sf)
    model = D.build_model(D.derive_model(catalog, composites=found), "db", frames)
    claim = model.source("claim").extend(dimensions=[dim("number", "first_order_line.l_linenumber"), dim("last_number", "last_line_line.l_linenumber")],
                                         measures=[Measure("numbers", "sum", "number"), Measure("last_numbers", "sum", "last_number")])
    return run(Model({**model.sources, "claim": claim}), "claim", group_by=[("flag", "first_order_line.l_returnflag")], aggregate=["row_count", "numbers", "last_numbers"])


@query("a12_duplicate_refs", joins_sql("SELECT db_id, MIN(ref_no) AS ref_no, src_idx, src_table, src_column, dst_idx, dst_table, dst_column "
                                       "FROM cat_refs GROUP BY ALL"))
def a12(spark, sf):
    return D.derive_joins(catalogs(spark, sf), drop_duplicates=True)


@query("a13_dimensions", CATALOG_SQL + f"SELECT db_id, {sql_snake('table_name')} AS source, {sql_snake('column_name')} AS dimension, column_name, "
       f"{sql_quoting('column_name')} AS needs_quoting FROM cat_columns WHERE lower({sql_snake('column_name')}) <> lower(column_name) OR {sql_quoting('column_name')}")
def a13(spark, sf):
    return D.derive_dimensions(catalogs(spark, sf).columns)


@query("a14_measures", CATALOG_SQL + f"SELECT db_id, {sql_snake('table_name')} AS source, p || '_' || {sql_snake('column_name')} AS measure, op, column_name "
       "FROM cat_columns, (VALUES ('sum', 'total'), ('avg', 'avg'), ('max', 'max'), ('min', 'min')) o(op, p) WHERE column_type = 'number' "
       f"UNION ALL SELECT db_id, {sql_snake('table_name')}, 'row_count', 'count', '' FROM cat_tables")
def a14(spark, sf):
    return D.derive_measures(catalogs(spark, sf)).withColumn("column_name", F.coalesce("column_name", F.lit("")))


@query("a15_full_model", LEVELS_SQL.replace("SELECT db_id, table_idx, level >= 12 AS cyclic", ", lv AS (SELECT db_id, table_idx, level >= 12 AS cyclic", 1) +
       f") SELECT t.db_id, {sql_snake('t.table_name')} AS source, t.table_name, COALESCE((SELECT string_agg(CASE WHEN lower({sql_snake('k.column_name')}) <> "
       f"lower(k.column_name) OR {sql_quoting('k.column_name')} THEN {sql_snake('k.column_name')} ELSE k.column_name END, ',' ORDER BY key_no) FROM cat_keys k "
       "WHERE k.db_id = t.db_id AND k.table_idx = t.table_idx), '') AS primary_key, level, cyclic FROM cat_tables t JOIN lv USING (db_id, table_idx)")
def a15(spark, sf):
    return D.derive_model(catalogs(spark, sf)).sources.withColumn("primary_key", F.array_join("primary_key", ","))


@query("a16_measure_warnings", CATALOG_SQL + f"""SELECT * FROM (SELECT db_id, {sql_snake('table_name')} AS source, column_name,
  CASE WHEN (db_id, col_idx) IN (SELECT (db_id, col_idx) FROM cat_keys) THEN 'key'
       WHEN (db_id, table_idx, column_name) IN (SELECT (db_id, src_idx, src_column) FROM cat_refs) THEN 'reference'
       WHEN regexp_matches({sql_snake('column_name')}, '(^|_)(i_?d|zip|zip_?code|phone|telephone|fax|code|number|year|ssn)(_val)?$') THEN 'code' END AS reason
  FROM cat_columns WHERE column_type = 'number') t WHERE reason IS NOT NULL""")
def a16(spark, sf):
    return D.measure_warnings(catalogs(spark, sf))


def _log(spark, sf):
    catalog, log = log_catalog(spark, sf), query_log(spark, sf)
    known = log.join(catalog.tables.select("db_id").distinct(), "db_id", "left_semi")
    return W.distinct_queries(known), catalog


@query("w1_group_log", LOG_SQL + "SELECT db_id, COUNT(*) AS queries, COUNT(DISTINCT lower(query)) AS texts FROM log GROUP BY db_id")
def w1(spark, sf):
    return W.distinct_queries(query_log(spark, sf)).groupBy("db_id").agg(F.sum("copies").alias("queries"), F.count("*").alias("texts"))


@query("w2_tables_used", LOG_SQL + "SELECT DISTINCT db_id, table_name FROM th")
def w2(spark, sf):
    return W.tables_used(*_log(spark, sf))


@query("w3_columns_used", LOG_SQL + "SELECT DISTINCT db_id, table_name, column_name FROM ch")
def w3(spark, sf):
    return W.columns_used(*_log(spark, sf))


@query("w4_aggregates_used", LOG_SQL + "SELECT DISTINCT db_id, table_name, agg, column_name FROM ah")
def w4(spark, sf):
    return W.aggregates_used(*_log(spark, sf))


JOIN_PIECES = r"regexp_extract_all(sql, '(\w+)\s*\.\s*(\w+)\s*=\s*(\w+)\s*\.\s*(\w+)', {})"
NAMED = r"regexp_extract_all(sql, '\b(?:from|join)\s+(\w+)(?:\s+as\s+(\w+)|\s+(t[0-9]))?', {})"
SIDES = ("SELECT DISTINCT db_id, CASE WHEN t1 > t2 THEN t2 ELSE t1 END AS left_table, CASE WHEN t1 > t2 THEN c2 ELSE c1 END AS left_col, "
         "CASE WHEN t1 > t2 THEN t1 ELSE t2 END AS right_table, CASE WHEN t1 > t2 THEN c1 ELSE c2 END AS right_col FROM {} "
         "WHERE t1 IN (SELECT table_name FROM names) AND t2 IN (SELECT table_name FROM names)")
PIECES_SQL = ", m AS (SELECT db_id, sql, " + ", ".join(f"unnest({JOIN_PIECES.format(i)}) AS {n}" for i, n in enumerate(("t1", "c1", "t2", "c2"), 1)) + " FROM q)"


@query("w5_joins_used", LOG_SQL + PIECES_SQL + SIDES.format("m"))
def w5(spark, sf):
    return W.joins_used(*_log(spark, sf))


@query("w6_joins_used_by_alias", LOG_SQL + PIECES_SQL + ", b AS (SELECT db_id, sql, " +
       ", ".join(f"unnest({NAMED.format(i)}) AS {n}" for i, n in enumerate(("t", "a1", "a2"), 1)) + " FROM q), "
       "al AS (SELECT db_id, sql, t, unnest([t, a1, a2]) AS alias FROM b), "
       "r AS (SELECT m.db_id, x.t AS t1, c1, y.t AS t2, c2 FROM m JOIN al x ON x.db_id = m.db_id AND x.sql = m.sql AND x.alias = t1 "
       "JOIN al y ON y.db_id = m.db_id AND y.sql = m.sql AND y.alias = t2) " + SIDES.format("r"))
def w6(spark, sf):
    return W.joins_used(*_log(spark, sf), resolve_aliases=True)


SCOPED = (
    ("SELECT a.o_orderkey FROM orders a, customer AS b WHERE a.o_custkey = b.c_custkey AND a.o_orderkey > ", [("customer", "c_custkey", "orders", "o_custkey")]),
    ("SELECT t.n_name FROM nation t WHERE t.n_regionkey IN (SELECT t.r_regionkey FROM region t JOIN supplier s ON t.r_regionkey = s.s_suppkey) AND t.n_regionkey < ",
     [("region", "r_regionkey", "supplier", "s_suppkey")]),
    ("SELECT 1 FROM orders x JOIN customer y ON x.o_custkey = y.c_custkey UNION SELECT 2 FROM nation x JOIN region y ON x.n_regionkey = y.r_regionkey LIMIT ",
     [("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_regionkey", "region", "r_regionkey")]),
    ("SELECT p.p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l, (SELECT s_suppkey AS k FROM supplier) s WHERE l.l_partkey = p.p_partkey AND s.k = l.l_suppkey) AND p.p_retailprice > ",
     [("lineitem", "l_partkey", "part", "p_partkey")]),
    ("SELECT COUNT(*) FROM (orders o JOIN customer c ON o.o_custkey = c.c_custkey) LEFT JOIN nation n ON c.c_custkey = n.n_regionkey, region r WHERE r.r_regionkey = n.n_regionkey AND o.o_orderkey = ",
     [("customer", "c_custkey", "nation", "n_regionkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("nation", "n_regionkey", "region", "r_regionkey")]),
)


@query("w6_aliases_by_scope", LOG_SQL + ", e(kind, left_table, left_col, right_table, right_col) AS (VALUES " + ", ".join(
    f"({k}, '{a}', '{b}', '{c}', '{d}')" for k, (_, found) in enumerate(SCOPED) for a, b, c, d in found) + f""")
SELECT DISTINCT k.db_id, left_table, left_col, right_table, right_col FROM lineitem JOIN known k ON k.db_id = 'db_' || l_suppkey JOIN e ON e.kind = l_partkey % {len(SCOPED)}""")
def w6b(spark, sf):
    """Comma joins, subqueries and unions that use one alias for several tables."""
    texts = F.array(*[F.lit(t) for t, _ in SCOPED])
    log = table(spark, sf, "lineitem").select(F.concat(F.lit("db_"), "l_suppkey").alias("db_id"), F.concat(
        F.get(texts, (F.col("l_partkey") % len(SCOPED)).cast("int")), F.col("l_quantity").cast("int").cast("string")).alias("query"))
    catalog = log_catalog(spark, sf)
    return W.joins_used(W.distinct_queries(log.join(catalog.tables.select("db_id").distinct(), "db_id", "left_semi")), catalog, resolve_aliases=True)


@query("w7_analysis_report", LOG_SQL + PIECES_SQL + f""", j AS ({SIDES.format('m')}),
n AS (SELECT db_id, COUNT(*) AS query_count FROM log SEMI JOIN known USING (db_id) GROUP BY 1),
t AS (SELECT db_id, string_agg(table_name, ',' ORDER BY table_name) AS tables_used FROM (SELECT DISTINCT db_id, table_name FROM th) GROUP BY 1),
d AS (SELECT db_id, string_agg(x, ';' ORDER BY x) AS dimensions FROM (SELECT db_id, table_name || ':' || string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS x
  FROM ch GROUP BY db_id, table_name) GROUP BY 1),
a AS (SELECT db_id, string_agg(x, ';' ORDER BY x) AS measures FROM (SELECT db_id, table_name || ':' || agg || ':' || string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS x
  FROM ah GROUP BY db_id, table_name, agg) GROUP BY 1),
k AS (SELECT db_id, string_agg(left_table || '.' || left_col || '=' || right_table || '.' || right_col, ';' ORDER BY left_table) AS joins FROM j GROUP BY 1)
SELECT n.db_id, query_count, COALESCE(tables_used, '') AS tables_used, COALESCE(dimensions, '') AS dimensions, COALESCE(measures, '') AS measures, COALESCE(joins, '') AS joins
FROM n LEFT JOIN t USING (db_id) LEFT JOIN d USING (db_id) LEFT JOIN a USING (db_id) LEFT JOIN k USING (db_id)""")
def w7(spark, sf):
    report = W.analysis_report(query_log(spark, sf), log_catalog(spark, sf))
    text = lambda c: F.coalesce(c, F.lit(""))
    return report.select(
        "db_id", "query_count", text(F.array_join("tables_used", ",")).alias("tables_used"),
        text(F.array_join(F.array_sort(F.transform("dimensions", lambda d: F.concat_ws(":", d["table_name"], F.array_join(d["columns"], ",")))), ";")).alias("dimensions"),
        text(F.array_join(F.array_sort(F.transform("measures", lambda m: F.concat_ws(":", m["table_name"], m["agg"], F.array_join(m["columns"], ",")))), ";")).alias("measures"),
        text(F.array_join(F.transform("joins", lambda j: F.concat(j["left_table"], F.lit("."), j["left_col"], F.lit("="), j["right_table"], F.lit("."), j["right_col"])), ";")).alias("joins"))


MINIMAL_SQL = LOG_SQL + """, ms AS (SELECT DISTINCT db_id, table_name AS source, 'row_count' AS measure FROM ch
  UNION ALL SELECT DISTINCT db_id, table_name, agg || '_' || column_name FROM ah)
"""


@query("w8_minimal_model", MINIMAL_SQL + "SELECT db_id, 'source' AS kind, table_name AS source, '' AS name FROM (SELECT DISTINCT db_id, table_name FROM th) "
       "UNION ALL SELECT db_id, 'dimension', table_name, column_name FROM (SELECT DISTINCT db_id, table_name, column_name FROM ch) "
       "UNION ALL SELECT db_id, 'measure', source, measure FROM ms")
def w8(spark, sf):
    sources, dims, measures = W.derive_minimal(query_log(spark, sf), log_catalog(spark, sf))
    return (sources.select("db_id", F.lit("source").alias("kind"), "source", F.lit("").alias("name"))
            .union(dims.select("db_id", F.lit("dimension"), "source", "dimension"))
            .union(measures.select("db_id", F.lit("measure"), "source", "measure")))


@query("w9_log_summary", LOG_SQL + "SELECT COUNT(DISTINCT CASE WHEN db_id IN (SELECT db_id FROM known) THEN db_id END) AS databases_processed, "
       "COUNT(DISTINCT CASE WHEN db_id NOT IN (SELECT db_id FROM known) THEN db_id END) AS databases_skipped, "
       "COUNT(CASE WHEN db_id IN (SELECT db_id FROM known) THEN 1 END) AS total_queries FROM log")
def w9(spark, sf):
    return W.log_summary(query_log(spark, sf), log_catalog(spark, sf))


@query("v1_smoke_count", " UNION ALL ".join(f"SELECT '{t}' AS source, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def v1(spark, sf):
    return V.smoke_count(sales_model(spark, sf))


FIRST = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_mktsegment", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderstatus",
         "lineitem": "l_returnflag", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "conversations": "conv_id", "pages": "page_id",
         "benchmark": "item_id", "embeddings": "vec_id"}


@query("v2_smoke_group", " UNION ALL ".join(f"SELECT '{t}' AS source, COUNT(DISTINCT {c}) AS n_groups, COUNT(*) AS row_count FROM {t}" for t, c in FIRST.items()))
def v2(spark, sf):
    return V.smoke_group(sales_model(spark, sf))


@query("v3_preview", "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5")
def v3(spark, sf):
    return V.preview(sales_model(spark, sf), "supplier", ["s_suppkey"])


TESTS_SQL = ("WITH tests AS (SELECT 'db_' || l_suppkey AS db_id, 'source_' || l_orderkey AS source, l_quantity < 50 OR l_suppkey < 50 AS passed, "
             "'error in ' || l_partkey || repeat(' long', 60) AS output FROM lineitem), dbs AS (SELECT 'db_' || c_custkey AS db_id FROM customer), "
             "v AS (SELECT db_id, COUNT(source) AS sources_tested, COUNT(CASE WHEN NOT passed THEN 1 END) AS failed, "
             "MIN(CASE WHEN NOT passed THEN output END) AS e FROM dbs LEFT JOIN tests USING (db_id) GROUP BY db_id), "
             "verdict AS (SELECT db_id, CASE WHEN sources_tested = 0 THEN 'SKIP' WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status, "
             "CASE WHEN sources_tested = 0 THEN 'no model' WHEN failed = 0 THEN '' ELSE e END AS reason, sources_tested, failed FROM v) ")


def _tests(spark, sf):
    tests = table(spark, sf, "lineitem").select(
        F.concat(F.lit("db_"), "l_suppkey").alias("db_id"), F.concat(F.lit("source_"), "l_orderkey").alias("source"),
        ((F.col("l_quantity") < 50) | (F.col("l_suppkey") < 50)).alias("passed"),
        F.concat(F.lit("error in "), "l_partkey", F.repeat(F.lit(" long"), 60)).alias("output"))
    return tests, table(spark, sf, "customer").select(F.concat(F.lit("db_"), "c_custkey").alias("db_id"))


@query("v4_verdicts", TESTS_SQL + "SELECT db_id, status, reason, sources_tested, failed FROM verdict")
def v4(spark, sf):
    return V.verdicts(*_tests(spark, sf))


@query("v5_validation_summary", TESTS_SQL + "SELECT COUNT(CASE WHEN status = 'PASS' THEN 1 END) AS passed, COUNT(CASE WHEN status = 'FAIL' THEN 1 END) AS failed, "
       "COUNT(CASE WHEN status = 'SKIP' THEN 1 END) AS skipped FROM verdict")
def v5(spark, sf):
    return V.validation_summary(V.verdicts(*_tests(spark, sf)))


@query("v5_first_errors", TESTS_SQL + "SELECT db_id, source, output AS error FROM tests WHERE NOT passed")
def v5b(spark, sf):
    return V.first_errors(_tests(spark, sf)[0])


def key_sql(t, key):
    return (f"SELECT SUM(n)::BIGINT AS n_rows, COUNT(*) AS n_keys, COUNT(CASE WHEN n > 1 THEN 1 END) AS duplicate_keys, MAX(n) AS max_per_key, 0::BIGINT AS null_rows, "
            f"MAX(n) = 1 AS is_key FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY {key}) g")


@query("v6_key_audit_true", key_sql("orders", "o_orderkey"))
def v6(spark, sf):
    return V.audit_key(table(spark, sf, "orders"), ["o_orderkey"])


@query("v6_key_audit_false", key_sql("lineitem", "l_orderkey, l_linenumber"))
def v6b(spark, sf):
    return V.audit_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def fk_sql(left, right, lk, rk):
    return (f"SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT({lk}) AS null_rows, COUNT(CASE WHEN {lk} NOT IN (SELECT {rk} FROM {right}) THEN 1 END) AS orphan_rows, "
            f"COUNT(CASE WHEN {lk} IN (SELECT {rk} FROM {right}) THEN 1 END) AS matched_rows, "
            f"COUNT(CASE WHEN {lk} IN (SELECT {rk} FROM {right}) THEN 1 END) / COUNT(*) AS match_rate, "
            f"(SELECT COUNT(DISTINCT {rk}) FROM {right} WHERE {rk} NOT IN (SELECT {lk} FROM {left})) AS unreferenced_keys FROM {left}")


@query("v7_reference_audit", fk_sql("lineitem", "orders", "l_orderkey", "o_orderkey"))
def v7(spark, sf):
    return V.audit_fk(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")])


@query("v7_reference_audit_orphans", fk_sql("documents", "labels", "doc_id", "doc_id"))
def v7b(spark, sf):
    return V.audit_fk(table(spark, sf, "documents"), table(spark, sf, "labels"), [("doc_id", "doc_id")])


@query("v8_cardinality_audit", "SELECT MAX(m) AS max_matches, SUM(CASE WHEN m > 1 THEN 1 ELSE 0 END)::BIGINT AS multi_rows, SUM(greatest(m, 1))::BIGINT AS joined_rows, "
       "MAX(m) <= 1 AS is_one FROM (SELECT o_orderkey, COUNT(l_orderkey) AS m FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) t")
def v8(spark, sf):
    return V.audit_cardinality(table(spark, sf, "orders"), table(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")])


JOINS = [("nation", "region", "region", "n_regionkey", "r_regionkey"), ("customer", "nation", "nation", "c_nationkey", "n_nationkey"),
         ("supplier", "nation", "nation", "s_nationkey", "n_nationkey"), ("orders", "customer", "customer", "o_custkey", "c_custkey"),
         ("lineitem", "orders", "orders", "l_orderkey", "o_orderkey"), ("lineitem", "part", "part", "l_partkey", "p_partkey"),
         ("lineitem", "supplier", "supplier", "l_suppkey", "s_suppkey"), ("events", "customer", "customer", "user_id", "c_custkey"),
         ("labels", "documents", "documents", "doc_id", "doc_id")]


@query("v8_audit_all_joins", " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{j}' AS join_name, MAX(m) AS max_matches, 0::BIGINT AS multi_rows, COUNT(*) AS joined_rows, true AS is_one FROM "
    f"(SELECT (SELECT COUNT(*) FROM {t} x WHERE x.{rk} = y.{lk}) AS m FROM {s} y) z" for s, j, t, lk, rk in JOINS))
def v8b(spark, sf):
    return V.audit_model_joins(sales_model(spark, sf))


@query("v9_missing_columns", CATALOG_SQL + f"SELECT db_id, lower(table_name) AS table_name, lower(column_name) AS column_name FROM cat_columns "
       f"WHERE NOT (lower({sql_snake('column_name')}) <> lower(column_name) OR {sql_quoting('column_name')})")
def v9(spark, sf):
    c = catalogs(spark, sf)
    names = c.tables.select("db_id", "table_name", N.source_name(F.col("table_name")).alias("source"))
    return V.missing_columns(c.columns, D.derive_dimensions(c.columns).join(names, ["db_id", "source"]))


COUNTS_SQL = CATALOG_SQL + f""", counts AS (SELECT db_id, COUNT(DISTINCT table_idx) AS sources,
  COUNT(CASE WHEN lower({sql_snake('column_name')}) <> lower(column_name) OR {sql_quoting('column_name')} THEN 1 END) AS dimensions,
  COUNT(DISTINCT table_idx) + 4 * COUNT(CASE WHEN column_type = 'number' THEN 1 END) AS measures,
  (SELECT COUNT(*) FROM cat_refs r WHERE r.db_id = c.db_id AND src_idx <> dst_idx) AS joins FROM cat_columns c GROUP BY db_id)
"""


@query("c1_element_counts", COUNTS_SQL + "SELECT * FROM counts")
def c1(spark, sf):
    return C.element_counts(D.derive_model(catalogs(spark, sf)))


@query("c2_model_overview", COUNTS_SQL + "SELECT COUNT(*) AS databases, " + ", ".join(
    f"SUM({k})::BIGINT AS total_{k}, round(SUM({k}) / COUNT(*), 1) AS avg_{k}_per_db" for k in C.KINDS) + " FROM counts")
def c2(spark, sf):
    return C.model_overview(C.element_counts(D.derive_model(catalogs(spark, sf))))


BANDS = ("CASE WHEN sources <= 3 THEN 'simple (1-3 tables)' WHEN sources <= 7 THEN 'medium (4-7 tables)' "
         "WHEN sources <= 15 THEN 'complex (8-15 tables)' ELSE 'very complex (16+ tables)' END")


@query("c3_complexity", f"SELECT {BANDS} AS complexity, COUNT(*) AS databases FROM (SELECT o_custkey, COUNT(*) AS sources FROM orders GROUP BY 1) t GROUP BY 1")
def c3(spark, sf):
    return C.complexity_distribution(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("sources")))


@query("c4_full_and_minimal", MINIMAL_SQL + """SELECT 'full' AS layer, COUNT(*) AS files, COUNT(*) * 8 AS sources,
  COUNT(*) * (SELECT COUNT(*) FROM shape WHERE column_name IN ('Part Size')) AS dimensions,
  COUNT(*) * (8 + 4 * (SELECT COUNT(*) FROM shape WHERE column_type = 'number')) AS measures, 0::BIGINT AS joins FROM known
  UNION ALL SELECT 'minimal', (SELECT COUNT(DISTINCT db_id) FROM th), (SELECT COUNT(DISTINCT (db_id, table_name)) FROM th),
  (SELECT COUNT(DISTINCT (db_id, table_name, column_name)) FROM ch), (SELECT COUNT(*) FROM ms), 0""")
def c4(spark, sf):
    catalog = log_catalog(spark, sf)
    full = D.derive_model(catalog)
    sources, dims, measures = W.derive_minimal(query_log(spark, sf), catalog)
    minimal = D.ModelTables(sources, dims, measures, full.joins.limit(0))
    return C.coverage_comparison(C.element_counts(full), C.element_counts(minimal))


@query("c5_column_coverage", LOG_SQL + """, u AS (SELECT DISTINCT db_id, table_name, column_name FROM ch)
SELECT k.db_id, COUNT(*) AS full_columns, COUNT(u.db_id) AS minimal_columns, COUNT(u.db_id) / COUNT(*) AS coverage_ratio,
  string_agg(CASE WHEN u.db_id IS NULL THEN n.table_name || '.' || n.column_name END, ',' ORDER BY n.table_name || '.' || n.column_name) AS unused_columns
FROM known k CROSS JOIN names n LEFT JOIN u ON u.db_id = k.db_id AND u.table_name = n.table_name AND u.column_name = n.column_name GROUP BY k.db_id""")
def c5(spark, sf):
    queries, catalog = _log(spark, sf)
    out = C.column_coverage(catalog.columns, W.columns_used(queries, catalog))
    return out.withColumn("unused_columns", F.array_join("unused_columns", ","))
