"""Catalogs, query logs, results and usage logs that grow with the test tables.

Each has a Spark form and the SQL that builds the same relation.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import spread, table
from semaspark.functions.naming import INTERNAL_TABLES, RESERVED_WORDS
from semaspark.sources.catalog import RAW_SCHEMA, Catalog, load_catalog, raw_catalog


def db(name, tables, columns, keys=(), refs=()):
    """``columns``: 'table.column:type'; keys and refs by the same 'table.column'."""
    names, types, at = [[-1, "*"]], ["text"], {}
    for spec in columns:
        path, kind = spec.rsplit(":", 1)
        table, column = path.split(".", 1)
        at[path] = len(names)
        names.append([tables.index(table), column])
        types.append(kind)
    return {"db_id": name, "table_names_original": tables, "column_names_original": names, "column_types": types,
            "primary_keys": [at[k] for k in keys], "foreign_keys": [[at[a], at[b]] for a, b in refs]}


ROLES = ("President", "Vice_President", "Secretary", "Treasurer", "Class_President", "Class_Senator", "Student_ID")

CATALOGS = [
    db("concert", ["stadium", "singer", "concert", "singer_in_concert"],
       ["stadium.Stadium_ID:number", "stadium.Name:text", "stadium.Capacity:number", "singer.Singer_ID:number", "singer.Name:text",
        "singer.Age:number", "concert.concert_ID:number", "concert.Stadium_ID:text", "concert.Year:text",
        "singer_in_concert.concert_ID:number", "singer_in_concert.Singer_ID:text"],
       ["stadium.Stadium_ID", "singer.Singer_ID", "concert.concert_ID", "singer_in_concert.concert_ID"],
       [("concert.Stadium_ID", "stadium.Stadium_ID"), ("singer_in_concert.Singer_ID", "singer.Singer_ID"),
        ("singer_in_concert.concert_ID", "concert.concert_ID")]),
    db("flights", ["airlines", "airports", "flights"],
       ["airlines.uid:number", "airports.AirportCode:text", "flights.Airline:number", "flights.FlightNo:number",
        "flights.SourceAirport:text", "flights.DestAirport:text"],
       ["airlines.uid", "airports.AirportCode", "flights.Airline", "flights.FlightNo"],
       [("flights.DestAirport", "airports.AirportCode"), ("flights.SourceAirport", "airports.AirportCode")]),
    db("friends", ["Highschooler", "Friend"],
       ["Highschooler.ID:number", "Friend.student_id:number", "Friend.friend_id:number"],
       ["Highschooler.ID", "Friend.student_id"],
       [("Friend.friend_id", "Highschooler.ID"), ("Friend.student_id", "Highschooler.ID")]),
    db("dogs", ["Owners", "Dogs"], ["Owners.owner_id:number", "Dogs.dog_id:number", "Dogs.owner_id:number"],
       ["Owners.owner_id", "Dogs.dog_id"],
       [("Dogs.owner_id", "Owners.owner_id"), ("Dogs.owner_id", "Owners.owner_id")]),
    db("rooms", ["Block", "Room"], ["Block.BlockFloor:number", "Block.BlockCode:number", "Room.RoomNumber:number",
                                    "Room.BlockFloor:number", "Room.BlockCode:number"],
       ["Block.BlockCode", "Room.RoomNumber"],
       [("Room.BlockFloor", "Block.BlockFloor"), ("Room.BlockCode", "Block.BlockCode")]),
    db("self", ["employee"], ["employee.id:number", "employee.boss_id:number"], ["employee.id"], [("employee.boss_id", "employee.id")]),
    db("cycle", ["a", "b", "c"], ["a.id:number", "a.b_id:number", "b.id:number", "b.a_id:number", "c.id:number", "c.a_id:number"],
       ["a.id", "b.id", "c.id"], [("a.b_id", "b.id"), ("b.a_id", "a.id"), ("c.a_id", "a.id")]),
    db("odd", ["team", "match_season", "sqlite_sequence"],
       ["team.Team_id:number", "team.Home Town:text", "team.%_Change_2007:number", "match_season.Team:number",
        "match_season.Official_ratings_(millions):number", "sqlite_sequence.seq:number"],
       ["team.Team_id"], [("match_season.Team", "team.Team_id")]),
    db("votes", ["people_list", "votes"],
       ["people_list.Person_ID:number", "people_list.Full Name:text",
        *[f"votes.{role}_Vote:number" for role in ROLES]], ["people_list.Person_ID"],
       [(f"votes.{role}_Vote", "people_list.Person_ID") for role in ROLES]),
]


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
                                     for v in row) + ")" for row in rows)


# --- catalogs: every customer is a database shaped like one of the small catalogs -----

def raw_catalogs(spark, sf) -> DataFrame:
    shape = "array<struct<" + RAW_SCHEMA.replace("db_id string, ", "").replace(" array", ": array") + ">>"
    shapes = F.from_json(F.lit(json.dumps(CATALOGS)), shape)
    at = (F.col("c_nationkey") % len(CATALOGS)).cast("int")
    return spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(
        F.concat(F.lit("db_"), "c_custkey").alias("db_id"), F.get(shapes, at).alias("s")).select("db_id", "s.*")


def catalogs(spark, sf) -> Catalog:
    return load_catalog(raw_catalog(raw_catalogs(spark, sf)))


_TABLES = [(k, i, t) for k, c in enumerate(CATALOGS) for i, t in enumerate(c["table_names_original"])]
_COLUMNS = [(k, i, t, n, c["column_types"][i]) for k, c in enumerate(CATALOGS) for i, (t, n) in enumerate(c["column_names_original"])]
_KEYS = [(k, i, p) for k, c in enumerate(CATALOGS) for i, p in enumerate(c["primary_keys"])]
_REFS = [(k, i, a, b) for k, c in enumerate(CATALOGS) for i, (a, b) in enumerate(c["foreign_keys"])]

CATALOG_SQL = f"""WITH dbs AS (SELECT 'db_' || c_custkey AS db_id, c_nationkey % {len(CATALOGS)} AS k FROM customer),
v_tables(k, table_idx, table_name) AS (VALUES {_values(_TABLES)}),
v_columns(k, col_idx, table_idx, column_name, column_type) AS (VALUES {_values(_COLUMNS)}),
v_keys(k, key_no, col_idx) AS (VALUES {_values(_KEYS)}),
v_refs(k, ref_no, fk, pk) AS (VALUES {_values(_REFS)}),
k_tables AS (SELECT * FROM v_tables WHERE lower(table_name) NOT IN ({_list(INTERNAL_TABLES)})),
k_columns AS (SELECT c.*, t.table_name FROM v_columns c JOIN k_tables t ON c.k = t.k AND c.table_idx = t.table_idx),
cat_tables AS (SELECT db_id, table_idx, table_name FROM dbs JOIN k_tables USING (k)),
cat_columns AS (SELECT db_id, table_idx, table_name, col_idx, column_name, column_type FROM dbs JOIN k_columns USING (k)),
cat_keys AS (SELECT db_id, table_idx, table_name, key_no, c.col_idx, column_name FROM dbs JOIN v_keys v USING (k) JOIN k_columns c
  ON c.k = v.k AND c.col_idx = v.col_idx),
cat_refs AS (SELECT db_id, ref_no, s.table_idx AS src_idx, s.table_name AS src_table, s.column_name AS src_column,
  d.table_idx AS dst_idx, d.table_name AS dst_table, d.column_name AS dst_column FROM dbs JOIN v_refs v USING (k)
  JOIN k_columns s ON s.k = v.k AND s.col_idx = v.fk JOIN k_columns d ON d.k = v.k AND d.col_idx = v.pk)
"""


def sql_clean(x: str) -> str:
    bare = f"translate(regexp_replace({x}, '\\([^)]*\\)', '', 'g'), ' -./\\''', '_____')"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g'), '_')"


def sql_snake(x: str, acronym: bool = False) -> str:
    split = f"regexp_replace({sql_clean(x)}, '([A-Z])', '_\\1', 'g')"
    if acronym:
        split = (f"regexp_replace(regexp_replace({sql_clean(x)}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')")
    snake = f"trim(regexp_replace(lower({split}), '_+', '_', 'g'), '_')"
    safe = f"CASE WHEN {snake} IN ({_list(RESERVED_WORDS)}) THEN {snake} || '_val' ELSE {snake} END"
    return f"(CASE WHEN regexp_matches({safe}, '^([0-9]|$)') THEN 'col_' || ({safe}) ELSE {safe} END)"


def sql_quoting(x: str) -> str:
    return (f"(regexp_matches({x}, '[()\\[\\] \\-/%]') OR regexp_matches({x}, '^[^\\p{{L}}_]') OR lower({x}) IN ({_list(RESERVED_WORDS)}))")


# --- query logs: every supplier is a database, every line item a question ------------

LOG_TABLES = {
    "LineItem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_acctbal"], "part": ["p_partkey", "Part Size", "p_retailprice"],
    "nation": ["n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_acctbal", "s_nationkey"],
    "sales_notes": ["note"],
}
_LOG_COLUMNS = [(i, t, c, "text" if c.endswith(("name", "date", "note")) else "number") for i, (t, cs) in enumerate(LOG_TABLES.items()) for c in cs]


def log_catalog(spark, sf) -> Catalog:
    """Suppliers in debt have no catalog."""
    names = F.array(*[F.lit(t) for t in LOG_TABLES])
    columns = F.array(*[F.struct(F.lit(i).alias("table_idx"), F.lit(c).alias("name")) for i, _, c, _ in _LOG_COLUMNS])
    return load_catalog(spread(table(spark, sf, "supplier").filter("s_acctbal >= 0").select("s_suppkey")).select(
        F.concat(F.lit("db_"), "s_suppkey").alias("db_id"), names.alias("table_names_original"), columns.alias("column_names_original"),
        F.array(*[F.lit(x) for *_, x in _LOG_COLUMNS]).alias("column_types"), F.array().cast("array<int>").alias("primary_keys"),
        F.array().cast("array<struct<fk: int, pk: int>>").alias("foreign_keys")))


LOG_TEXT = """CASE l_linenumber % 5
  WHEN 0 THEN 'SELECT COUNT(DISTINCT ' || (CASE l_partkey % 4 WHEN 0 THEN 'l_partkey' WHEN 1 THEN 'l_suppkey' WHEN 2 THEN 'L_LineNumber' ELSE 'l_shipdate' END)
    || '), SUM(l_tax) FROM lineitem WHERE l_quantity > ' || CAST(l_quantity AS INT)
  WHEN 1 THEN 'SELECT T1.o_orderkey FROM orders AS T1 JOIN customer T2 ON T1.o_custkey = T2.c_custkey WHERE T2.c_acctbal > ' || CAST(l_quantity AS INT)
  WHEN 2 THEN 'select AVG(part size), max ( p_retailprice ) from part where noted < ' || CAST(l_quantity AS INT)
  WHEN 3 THEN 'SELECT n_name FROM nation JOIN region ON region.r_regionkey = nation.n_regionkey ORDER BY n_name LIMIT ' || CAST(l_quantity AS INT)
  ELSE 'SELECT discount (s_acctbal), min(s_suppkey FROM supplier WHERE s_nationkey = ' || CAST(l_quantity AS INT) END"""


def query_log(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.concat(F.lit("db_"), "l_suppkey").alias("db_id"), F.expr(LOG_TEXT).alias("query"))


LOG_SQL = f"""WITH log AS (SELECT 'db_' || l_suppkey AS db_id, {LOG_TEXT} AS query FROM lineitem),
known AS (SELECT 'db_' || s_suppkey AS db_id FROM supplier WHERE s_acctbal >= 0),
q AS MATERIALIZED (SELECT db_id, sql, regexp_extract_all(sql, '\\w+') AS words FROM (SELECT DISTINCT db_id, lower(query) AS sql FROM log) SEMI JOIN known USING (db_id)),
shape(table_idx, table_name, column_name, column_type) AS (VALUES {_values(_LOG_COLUMNS)}),
names AS (SELECT DISTINCT lower(table_name) AS table_name, lower(column_name) AS column_name FROM shape),
th AS (SELECT q.*, table_name FROM q JOIN (SELECT DISTINCT table_name FROM names) n ON list_contains(words, n.table_name)),
ch AS (SELECT th.*, column_name FROM th JOIN names n USING (table_name)
  WHERE CASE WHEN column_name = 'part size' THEN regexp_matches(sql, '\\bpart size\\b') ELSE list_contains(words, column_name) END),
ah AS (SELECT db_id, table_name, agg, column_name FROM ch, (VALUES ('count'), ('sum'), ('avg'), ('min'), ('max')) a(agg)
  WHERE regexp_matches(sql, agg || '\\s*\\([^)]*\\b' || column_name || '\\b'))
"""


# --- results and usage ---------------------------------------------------------------

def results(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("question_id"), F.col("event_type").alias("provider"), F.concat(F.lit("db_"), "user_id").alias("db_id"),
        (F.col("event_id") % 3 == 0).alias("match"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        F.col("value").alias("latency_ms"), "ts")


RESULTS_SQL = """WITH results AS (SELECT event_id AS question_id, event_type AS provider, 'db_' || user_id AS db_id, event_id % 3 = 0 AS match,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error, value AS latency_ms, ts FROM events)
"""

# An invented price list per million tokens, input and output; some prices have more than two decimals.
PRICES = [("amber", 4.0, 21.0), ("birch", 2.2, 9.9), ("cedar", 0.85, 3.4), ("dune", 1.6, 8.0), ("ember", 0.075, 0.31), ("fjord", 0.0125, 0.05)]
STEPS = ("build", "answer", "correct")


def prices(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_per_m double, output_per_m double")


def usage(spark, sf) -> DataFrame:
    line = table(spark, sf, "lineitem")
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    model = F.element_at(F.array(*[F.lit(p[0]) for p in PRICES]), (F.col("l_partkey") % len(PRICES) + 1).cast("int"))
    return line.select(F.col("l_orderkey").alias("question_id"), model.alias("model"), step.alias("step"),
                       (F.col("l_quantity").cast("int") * 20).alias("input_tokens"), (F.col("l_linenumber") * 7 + 5).alias("output_tokens"),
                       (F.col("l_returnflag") == "A").alias("cached"), (F.col("l_linestatus") == "F").alias("batch"))


USAGE_SQL = f"""WITH prices(model, i, o) AS (VALUES {", ".join(f"('{m}', {i}::DECIMAL(18,9), {o}::DECIMAL(18,9))" for m, i, o in PRICES)}),
usage AS (SELECT l_orderkey AS question_id, ([{_list(p[0] for p in PRICES)}])[l_partkey % {len(PRICES)} + 1] AS model,
  ([{_list(STEPS)}])[l_linenumber % 3 + 1] AS step, CAST(l_quantity AS INT) * 20 AS input_tokens, l_linenumber * 7 + 5 AS output_tokens,
  l_returnflag = 'A' AS cached, l_linestatus = 'F' AS batch FROM lineitem)
"""
