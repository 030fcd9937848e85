"""Sources, model declarations, the query surface, joins and set operations."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.registry import query, table, xavg, xsum
from semaspark.plans import relations as R
from semaspark.plans.model import Measure, Model, Source, dim, join_many, join_one, measure, numeric_measures, rename, row_count
from semaspark.plans.query import run
from semaspark.plans.tpch import sales_model
from semaspark.sources.records import write_results
from semaspark.session import staging_path

CHAIN = ("lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey "
         "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")


@query("flagship_revenue_by_region",
       f"SELECT r_name, COUNT(*) AS row_count, {xsum('l_extendedprice * (1 - l_discount)', 4)} AS total_net_price, "
       f"{xavg('l_extendedprice')} AS avg_l_extendedprice FROM {CHAIN} GROUP BY r_name")
def flagship(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["orders.customer.nation.region.r_name"],
               aggregate=["row_count", "total_net_price", "avg_l_extendedprice"], order_by="r_name")


@query("s1_table_source", "SELECT COUNT(*) AS row_count FROM orders")
def s1(spark, sf):
    src = Source.table(spark, "orders", f"{sf}/orders.parquet").extend(measures=[row_count()])
    return run(Model.build(src), "orders", aggregate=["row_count"])


@query("s2_sql_source", f"SELECT o_orderstatus, COUNT(*) AS row_count, {xsum('o_totalprice')} AS total_o_totalprice FROM orders "
       "WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def s2(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    src = Source.sql(spark, "big_orders", "SELECT * FROM orders WHERE o_totalprice > 100000").extend(
        measures=[row_count(), measure("sum", "o_totalprice", scale=2)])
    return run(Model.build(src), "big_orders", group_by=["o_orderstatus"], aggregate=["row_count", "total_o_totalprice"])


@query("s7_result_sink", "SELECT event_type AS provider, COUNT(*) AS n FROM events GROUP BY event_type")
def s7(spark, sf):
    path = staging_path(spark, "results")
    events = table(spark, sf, "events").select(F.col("event_id").alias("question_id"), F.col("event_type").alias("provider"), "value")
    write_results(events, path)
    return spark.read.parquet(path).groupBy("provider").agg(F.count("*").alias("n"))


@query("m1_extend", "SELECT c_mktsegment AS segment, COUNT(*) AS row_count, "
       f"{xsum('c_acctbal')} AS total_c_acctbal FROM customer GROUP BY c_mktsegment")
def m1(spark, sf):
    return run(sales_model(spark, sf), "customer", group_by=["segment"], aggregate=["row_count", "total_c_acctbal"])


@query("m2_primary_key", "SELECT p_partkey, n FROM (SELECT p_partkey, COUNT(*) AS n FROM part GROUP BY p_partkey) t")
def m2(spark, sf):
    model = sales_model(spark, sf)
    key = model.source("part").primary_key
    return run(model, "part", group_by=list(key), aggregate=[("n", "row_count")])


@query("m3_composite_key", "SELECT conv_id, turn, COUNT(*) AS row_count FROM conversations GROUP BY conv_id, turn")
def m3(spark, sf):
    model = sales_model(spark, sf)
    return run(model, "conversations", group_by=list(model.source("conversations").primary_key), aggregate=["row_count"])


@query("m4_rename", "SELECT l_returnflag AS return_flag, l_linestatus, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2")
def m4(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["return_flag", "l_linestatus"], aggregate=["row_count"])


@query("m5_calculated", "SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, o_orderstatus = 'O' AS is_open, COUNT(*) AS row_count "
       "FROM orders GROUP BY 1, 2")
def m5(spark, sf):
    return run(sales_model(spark, sf), "orders", group_by=["order_year", "is_open"], aggregate=["row_count"])


@query("m5_calculated_over_joins", "SELECT c_nationkey = s_nationkey AS ships_home, COUNT(*) AS row_count FROM lineitem "
       "LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def m5_joined(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["ships_home"], aggregate=["row_count"])


@query("m6_odd_identifiers", f"SELECT p_brand AS home_town, {xsum('p_retailprice')} AS total_change_2007, COUNT(p_size) AS ratings FROM part GROUP BY p_brand")
def m6(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_brand").alias("Home Town"), F.col("p_retailprice").alias("%_Change_2007"), F.col("p_size").alias("Ratings_(mil`l)"))
    src = Source.of("odd", raw).extend(dimensions=[rename("home_town", "Home Town"), rename("change_2007", "%_Change_2007")],
                                       measures=[measure("sum", "%_Change_2007", "total_change_2007", scale=2),
                                                 Measure("ratings", "count", "`Ratings_(mil``l)`")])
    return run(Model.build(src), "odd", group_by=["home_town"], aggregate=["total_change_2007", "ratings"])


@query("m7_m11_measures", "SELECT l_returnflag, COUNT(*) AS row_count, "
       f"{xsum('l_quantity')} AS total_l_quantity, {xavg('l_quantity')} AS avg_l_quantity, MAX(l_quantity) AS max_l_quantity, "
       f"MIN(l_quantity) AS min_l_quantity, {xsum('l_tax')} AS sum_l_tax, COUNT(l_partkey) AS count_l_partkey, "
       "COUNT(DISTINCT l_partkey) AS count_distinct_l_partkey FROM lineitem GROUP BY l_returnflag")
def m7(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["l_returnflag"], aggregate=[
        "row_count", "total_l_quantity", "avg_l_quantity", "max_l_quantity", "min_l_quantity", "sum_l_tax", "count_l_partkey",
        "count_distinct_l_partkey"])


@query("m12_join_on", "SELECT c_mktsegment AS segment, COUNT(*) AS row_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def m12(spark, sf):
    return run(sales_model(spark, sf), "orders", group_by=["customer.segment"], aggregate=["row_count"])


@query("m13_join_with", "SELECT r_name, COUNT(*) AS row_count FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def m13(spark, sf):
    return run(sales_model(spark, sf), "nation", group_by=["region.r_name"], aggregate=["row_count"])


@query("m14_role_playing", "SELECT cn.n_name AS buyer, sn.n_name AS seller, COUNT(*) AS row_count FROM lineitem "
       "LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey "
       "LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def m14(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=[("buyer", "orders.customer.nation.n_name"), ("seller", "supplier.nation.n_name")],
               aggregate=["row_count"])


@query("m14_aliased_target", "SELECT a.n_name AS smaller, b.n_name AS larger, COUNT(*) AS row_count FROM "
       "(SELECT least(c_nationkey, c_custkey % 25) AS x, greatest(c_nationkey, c_custkey % 25) AS y FROM customer) t "
       "LEFT JOIN nation a ON x = a.n_nationkey LEFT JOIN nation b ON y = b.n_nationkey GROUP BY 1, 2")
def m14b(spark, sf):
    base = sales_model(spark, sf)
    pairs = Source.of("pairs", table(spark, sf, "customer").select(
        F.least("c_nationkey", F.col("c_custkey") % 25).alias("x"), F.greatest("c_nationkey", F.col("c_custkey") % 25).alias("y")))
    pairs = pairs.extend(measures=[row_count()], joins=[join_one("first", [("x", "n_nationkey")], of="nation"), join_one("second", of="nation", with_="y")])
    return run(Model.build(pairs, *base.sources.values()), "pairs", group_by=[("smaller", "first.n_name"), ("larger", "second.n_name")],
               aggregate=["row_count"])


@query("m15_join_many", "SELECT c_mktsegment AS segment, COUNT(*) AS customers, SUM(n)::BIGINT AS orders FROM customer "
       "LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey GROUP BY 1")
def m15(spark, sf):
    return run(sales_model(spark, sf), "customer", group_by=["segment"], aggregate=[("customers", "row_count"), ("orders", "orders.row_count")])


LINES = ("(SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)")


@query("m16_composite_join", f"SELECT l_returnflag, COUNT(*) AS row_count, SUM(n)::BIGINT AS twins FROM lineitem l "
       f"LEFT JOIN {LINES} k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber GROUP BY 1")
def m16(spark, sf):
    lines = table(spark, sf, "lineitem")
    per_line = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    model = Model.build(
        Source.of("lines", lines).extend(
            dimensions=[dim("copies", "line.n")], measures=[row_count(), Measure("twins", "sum", "copies")],
            joins=[join_one("line", [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")])]),
        Source.of("line", per_line).extend(primary_key=["l_orderkey", "l_linenumber"]))
    return run(model, "lines", group_by=["l_returnflag"], aggregate=["row_count", "twins"])


@query("m17_path_access", f"SELECT n_name, r_name, MAX(l_extendedprice) AS max_l_extendedprice FROM {CHAIN} GROUP BY 1, 2")
def m17(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["orders.customer.nation.n_name", "orders.customer.nation.region.r_name"],
               aggregate=["max_l_extendedprice"])


@query("m18_reuse", "SELECT s_suppkey, s_name FROM supplier")
def m18(spark, sf):
    return sales_model(spark, sf).source("supplier").frame().select("s_suppkey", "s_name")


@query("q1_global_aggregate", f"SELECT COUNT(*) AS row_count, {xsum('l_extendedprice')} AS total_l_extendedprice FROM lineitem")
def q1(spark, sf):
    return run(sales_model(spark, sf), "lineitem", aggregate=["row_count", "total_l_extendedprice"])


@query("q2_group_by", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count, {xavg('l_extendedprice * (1 - l_discount)', 4)} AS avg_net_price "
       "FROM lineitem GROUP BY 1, 2")
def q2(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["l_returnflag", "l_linestatus"], aggregate=["row_count", "avg_net_price"])


@query("q3_projection", "SELECT *, c_mktsegment AS segment, c_acctbal < 0 AS in_debt FROM customer ORDER BY c_custkey LIMIT 5")
def q3(spark, sf):
    return run(sales_model(spark, sf), "customer", select="*", order_by="c_custkey", limit=5)


@query("q4_where", f"SELECT r_name, COUNT(*) AS row_count, {xsum('l_quantity')} AS total_l_quantity FROM {CHAIN} "
       "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND r_name <> 'ASIA' AND l_discount < 0.05 GROUP BY 1")
def q4(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["orders.customer.nation.region.r_name"], aggregate=["row_count", "total_l_quantity"],
               where=["l_shipdate >= timestamp_ntz '1996-01-01'", "orders.customer.nation.region.r_name <> 'ASIA'", "l_discount < 0.05"])


@query("q5_having", "SELECT l_suppkey, COUNT(*) AS row_count FROM lineitem GROUP BY 1 HAVING COUNT(*) > 590")
def q5(spark, sf):
    return run(sales_model(spark, sf), "lineitem", group_by=["l_suppkey"], aggregate=["row_count"], having="row_count > 590")


@query("q6_order_by", "SELECT p_brand, COUNT(*) AS row_count FROM part GROUP BY 1 ORDER BY row_count DESC, p_brand")
def q6(spark, sf):
    return run(sales_model(spark, sf), "part", group_by=["p_brand"], aggregate=["row_count"], order_by=["-row_count", "p_brand"])


@query("q7_top_k", "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
       "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q7(spark, sf):
    return run(sales_model(spark, sf), "orders", select=["o_orderkey", "o_totalprice", "customer.c_name"],
               order_by=["-o_totalprice", "o_orderkey"], limit=10)


ITEMS = f"(SELECT l_orderkey, COUNT(*) AS n, {xsum('l_quantity')} AS q, COUNT(l_quantity) AS nq FROM lineitem GROUP BY 1)"


@query("q8_fanout_safe", f"SELECT o_orderstatus AS status, COUNT(*) AS row_count, {xsum('o_totalprice')} AS total_o_totalprice, "
       f"COALESCE(SUM(n), 0)::BIGINT AS n_items, {xsum('q')} AS total_l_quantity, {xsum('q')} / SUM(nq) AS avg_l_quantity "
       f"FROM orders LEFT JOIN {ITEMS} i ON o_orderkey = l_orderkey GROUP BY 1")
def q8(spark, sf):
    return run(sales_model(spark, sf), "orders", group_by=["status"], aggregate=[
        "row_count", "total_o_totalprice", ("n_items", "items.row_count"), "items.total_l_quantity", "items.avg_l_quantity"])


@query("q8_group_by_many_side", f"SELECT l_returnflag AS return_flag, COUNT(*) AS row_count, {xsum('o_totalprice')} AS total_o_totalprice, "
       f"{xsum('q')} AS total_l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag, {xsum('l_quantity')} AS q FROM lineitem "
       "WHERE l_quantity > 5 GROUP BY 1, 2) i ON o_orderkey = l_orderkey WHERE l_orderkey IS NOT NULL GROUP BY 1")
def q8b(spark, sf):
    return run(sales_model(spark, sf), "orders", group_by=["items.return_flag"], aggregate=["row_count", "total_o_totalprice", "items.total_l_quantity"],
               where="items.l_quantity > 5")


@query("q8_distinct_and_one_side", f"SELECT o_orderstatus AS status, COUNT(*) AS row_count, MAX(p.parts) AS count_distinct_l_partkey, "
       f"MAX(b.bal) AS total_c_acctbal FROM orders o LEFT JOIN (SELECT o_orderstatus AS s, COUNT(DISTINCT l_partkey) AS parts FROM orders JOIN lineitem "
       f"ON o_orderkey = l_orderkey GROUP BY 1) p ON p.s = o.o_orderstatus LEFT JOIN (SELECT s, {xsum('c_acctbal')} AS bal FROM (SELECT DISTINCT "
       "o_orderstatus AS s, o_custkey FROM orders) d JOIN customer ON o_custkey = c_custkey GROUP BY 1) b ON b.s = o.o_orderstatus GROUP BY 1")
def q8c(spark, sf):
    return run(sales_model(spark, sf), "orders", group_by=["status"], aggregate=["row_count", "items.count_distinct_l_partkey", "customer.total_c_acctbal"])


@query("q9_distinct", "SELECT DISTINCT c_mktsegment AS segment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q9(spark, sf):
    return run(sales_model(spark, sf), "customer", select=["segment", "nation.n_name"], distinct=True)


Q10 = ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) "
       "GROUP BY o_orderpriority HAVING COUNT(*) > 1 ORDER BY n DESC, o_orderpriority LIMIT 3")


@query("q10_sql_text", Q10)
def q10(spark, sf):
    R.register_views(sales_model(spark, sf))
    return R.run_sql(spark, Q10)


@query("q10_sql_window", "SELECT o_custkey, o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn "
       "FROM orders QUALIFY rn <= 2")
def q10b(spark, sf):
    R.register_views(sales_model(spark, sf))
    return R.run_sql(spark, "SELECT * FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, "
                            "o_orderkey) AS rn FROM orders) t WHERE rn <= 2")


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("j1_inner_join", f"SELECT c_mktsegment, COUNT(*) AS n, {xsum('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey "
       "WHERE c_acctbal > 0 GROUP BY 1")
def j1(spark, sf):
    from semaspark.functions.exact import exact_sum
    joined = R.join(_orders(spark, sf), _customers(spark, sf).filter("c_acctbal > 0"), [("o_custkey", "c_custkey")], "inner")
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), exact_sum(F.col("o_totalprice")).alias("total"))


@query("j2_left_join", "SELECT c_custkey, COUNT(event_id) AS events FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1")
def j2(spark, sf):
    joined = R.join(_customers(spark, sf), table(spark, sf, "events"), [("c_custkey", "user_id")])
    return joined.groupBy("c_custkey").agg(F.count("event_id").alias("events"))


@query("j3_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def j3(spark, sf):
    return R.where_in(_customers(spark, sf), table(spark, sf, "events"), [("c_custkey", "user_id")]).select("c_custkey", "c_mktsegment")


@query("j4_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j4(spark, sf):
    return R.where_not_in(_customers(spark, sf), table(spark, sf, "events"), [("c_custkey", "user_id")]).select("c_custkey", "c_mktsegment")


@query("j4_null_aware_anti_join", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS k FROM orders) t "
       "WHERE k NOT IN (SELECT user_id FROM events)")
def j4b(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("k"))
    return R.where_not_in(left, table(spark, sf, "events"), [("k", "user_id")], null_aware=True).select("o_orderkey")


@query("j5_derived_table", "SELECT n, COUNT(*) AS row_count FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) t GROUP BY n")
def j5(spark, sf):
    inner = run(sales_model(spark, sf), "orders", group_by=["o_custkey"], aggregate=[("n", "row_count")])
    return run(Model.build(Source.of("per_customer", inner).extend(measures=[row_count()])), "per_customer", group_by=["n"], aggregate=["row_count"])


@query("j6_self_join", "SELECT p.c_mktsegment AS leader_segment, COUNT(*) AS row_count FROM customer c LEFT JOIN customer p ON c.c_nationkey = p.c_custkey GROUP BY 1")
def j6(spark, sf):
    src = Source.table(spark, "customer", f"{sf}/customer.parquet").extend(
        primary_key="c_custkey", measures=[row_count()], joins=[join_one("leader", [("c_nationkey", "c_custkey")], of="customer")])
    return run(Model.build(src), "customer", group_by=[("leader_segment", "leader.c_mktsegment")], aggregate=["row_count"])


A, B = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT user_id AS k FROM events"


def _keys(spark, sf):
    return (table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")),
            table(spark, sf, "events").select(F.col("user_id").alias("k")))


@query("t1_union", f"{A} UNION {B}")
def t1(spark, sf):
    return R.union(*_keys(spark, sf))


@query("t2_intersect", f"{A} INTERSECT {B}")
def t2(spark, sf):
    return R.intersect(*_keys(spark, sf))


@query("t3_except", f"{A} EXCEPT {B}")
def t3(spark, sf):
    return R.except_(*_keys(spark, sf))


@query("t3_except_all", f"{A} EXCEPT ALL {B}")
def t3b(spark, sf):
    return R.except_(*_keys(spark, sf), keep_duplicates=True)


@query("m12_dedupe_false_key", "SELECT o_orderstatus, COUNT(*) AS row_count, SUM(q)::DOUBLE AS total_q FROM orders LEFT JOIN "
       "(SELECT l_orderkey, MIN(l_quantity) AS q FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1")
def m12b(spark, sf):
    lines = Source.of("line", table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"))
    orders = Source.of("orders", table(spark, sf, "orders")).extend(
        dimensions=[dim("q", "line.l_quantity")], measures=[row_count(), Measure("total_q", "sum", "q", 2)],
        joins=[join_one("line", [("o_orderkey", "l_orderkey")])])
    return run(Model.build(lines, orders), "orders", group_by=["o_orderstatus"], aggregate=["row_count", "total_q"], on_violation="dedupe")


@query("q8_two_many_joins", "SELECT c_mktsegment AS segment, COUNT(*) AS row_count, COALESCE(SUM(no), 0)::BIGINT AS orders, COALESCE(SUM(ne), 0)::BIGINT AS events "
       "FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS no FROM orders GROUP BY 1) o ON c_custkey = o_custkey "
       "LEFT JOIN (SELECT user_id, COUNT(*) AS ne FROM events GROUP BY 1) e ON c_custkey = user_id GROUP BY 1")
def q8d(spark, sf):
    base = sales_model(spark, sf)
    customer = base.source("customer").extend(joins=[join_many("events", [("c_custkey", "user_id")])])
    model = Model({**base.sources, "customer": customer})
    return run(model, "customer", group_by=["segment"], aggregate=["row_count", ("orders", "orders.row_count"), ("events", "events.row_count")])


@query("m9_numeric_measures", f"SELECT s_nationkey, {xsum('s_acctbal')} AS total_s_acctbal, {xavg('s_acctbal')} AS avg_s_acctbal, "
       "MAX(s_acctbal) AS max_s_acctbal, MIN(s_acctbal) AS min_s_acctbal FROM supplier GROUP BY 1")
def m9(spark, sf):
    src = Source.of("supplier", table(spark, sf, "supplier")).extend(measures=numeric_measures("s_acctbal", 2))
    return run(Model.build(src), "supplier", group_by=["s_nationkey"], aggregate=[m.name for m in src.measures])


FULL = "(SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey)"


@query("q8_two_levels", f"""WITH f AS (SELECT * FROM {FULL} x),
a AS (SELECT c_mktsegment AS segment, l_returnflag AS flag, COUNT(DISTINCT c_custkey) AS customers, COUNT(l_orderkey) AS n_items, {xsum('l_quantity')} AS total_l_quantity,
  COUNT(DISTINCT l_suppkey) AS n_suppliers FROM f GROUP BY 1, 2),
b AS (SELECT segment, flag, COUNT(o_orderkey) AS n_orders, {xsum('o_totalprice')} AS total_o_totalprice FROM (SELECT DISTINCT c_mktsegment AS segment, l_returnflag AS flag, o_orderkey, o_totalprice FROM f) GROUP BY 1, 2),
c AS (SELECT segment, flag, {xsum('p_retailprice')} AS total_p_retailprice FROM (SELECT DISTINCT c_mktsegment AS segment, l_returnflag AS flag, p_partkey, p_retailprice FROM f LEFT JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)
SELECT a.*, n_orders, total_o_totalprice, total_p_retailprice FROM a JOIN b ON a.segment = b.segment AND a.flag IS NOT DISTINCT FROM b.flag JOIN c ON a.segment = c.segment AND a.flag IS NOT DISTINCT FROM c.flag""")
def q8_two_levels(spark, sf):
    base = sales_model(spark, sf)
    lineitem = base.source("lineitem").extend(measures=[Measure("n_suppliers", "count_distinct", "l_suppkey")])
    return run(Model({**base.sources, "lineitem": lineitem}), "customer", group_by=["segment", ("flag", "orders.items.return_flag")], aggregate=[
        ("customers", "row_count"), ("n_orders", "orders.row_count"), "orders.total_o_totalprice", ("n_items", "orders.items.row_count"), "orders.items.total_l_quantity",
        "orders.items.n_suppliers", "orders.items.part.total_p_retailprice"])


@query("q4_mixed_condition", f"""WITH f AS (SELECT * FROM {FULL} x WHERE l_quantity * 100 < c_acctbal AND l_extendedprice * 3 > o_totalprice AND o_orderstatus <> 'P')
SELECT c_mktsegment AS segment, COUNT(DISTINCT c_custkey) AS row_count, COUNT(*) AS n_items, {xsum('l_quantity')} AS total_l_quantity,
  (SELECT {xsum('o_totalprice')} FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM f g WHERE g.c_mktsegment = f.c_mktsegment)) AS total_o_totalprice FROM f GROUP BY 1""")
def q4_mixed_condition(spark, sf):
    return run(sales_model(spark, sf), "customer", group_by=["segment"], aggregate=["row_count", ("n_items", "orders.items.row_count"), "orders.items.total_l_quantity", "orders.total_o_totalprice"],
               where=["orders.items.l_quantity * 100 < c_acctbal", "orders.items.l_extendedprice * 3 > orders.o_totalprice", "orders.status <> 'P'"])


@query("q8_many_one_side_measures", f"""WITH f AS (SELECT l_returnflag, o_orderkey, o_totalprice, c_custkey, c_acctbal FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
c AS (SELECT l_returnflag, COUNT(c_custkey) AS customers, {xsum('c_acctbal')} AS total_c_acctbal, MIN(c_acctbal) AS min_c_acctbal,
  COALESCE(SUM((SELECT COUNT(*) FROM events WHERE user_id = c_custkey)), 0)::BIGINT AS n_events FROM (SELECT DISTINCT l_returnflag, c_custkey, c_acctbal FROM f) GROUP BY 1),
o AS (SELECT l_returnflag, COUNT(o_orderkey) AS orders, {xsum('o_totalprice')} AS total_o_totalprice FROM (SELECT DISTINCT l_returnflag, o_orderkey, o_totalprice FROM f) GROUP BY 1)
SELECT l_returnflag AS return_flag, customers, total_c_acctbal, min_c_acctbal, n_events, orders, total_o_totalprice, (SELECT COUNT(*) FROM lineitem l WHERE l.l_returnflag = c.l_returnflag) AS row_count FROM c JOIN o USING (l_returnflag)""")
def q8_many_one_side(spark, sf):
    base = sales_model(spark, sf)
    customer = base.source("customer").extend(joins=[join_many("events", [("c_custkey", "user_id")])])
    return run(Model({**base.sources, "customer": customer}), "lineitem", group_by=["return_flag"], aggregate=[
        "row_count", ("customers", "orders.customer.row_count"), "orders.customer.total_c_acctbal", "orders.customer.min_c_acctbal", ("n_events", "orders.customer.events.row_count"),
        ("orders", "orders.row_count"), "orders.total_o_totalprice"])


@query("m12_default_policy", "SELECT 'declared' AS name, (SELECT COUNT(*) FROM customer) AS rows UNION ALL SELECT 'other', CASE WHEN (SELECT COUNT(*) FROM nation) > (SELECT COUNT(DISTINCT n_regionkey) FROM nation) "
       "THEN -1 ELSE (SELECT COUNT(*) FROM region) END UNION ALL SELECT 'other, one row each', (SELECT COUNT(*) FROM region)")
def m12_default_policy(spark, sf):
    """A target is trusted by its declared key; by other columns the join stops at a second row."""
    base = sales_model(spark, sf)
    first = Source.of("first", table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("n_name")))
    region = base.source("region").extend(joins=[join_one("some", [("r_regionkey", "n_regionkey")], of="nation"), join_one("first", [("r_regionkey", "n_regionkey")])])
    model = Model({**base.sources, "region": region, "first": first})

    def count(source, field):
        try:
            return run(model, source, group_by=[field], aggregate=["row_count"]).agg(F.sum("row_count")).first()[0]
        except PySparkException as error:
            return -1 if "two rows for key" in str(error) else -2

    found = [("declared", count("customer", "nation.n_name")), ("other", count("region", "some.n_name")), ("other, one row each", count("region", "first.n_name"))]
    return spark.createDataFrame(found, "name string, rows bigint")
