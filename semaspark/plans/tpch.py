"""A model over the sales tables, used by the examples, the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from semaspark.plans.model import (Measure, Model, Source, dim, join_many, join_one, numeric_measures, rename,
                                   row_count, sum_alias)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "labels", "conversations", "pages", "benchmark", "embeddings")

_models: dict[tuple[str, str], Model] = {}


def sales_model(spark: SparkSession, sf_dir: str) -> Model:
    """Built once per session and folder; table schemas are read on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = _build(spark, sf_dir)
    return _models[key]


def _build(spark: SparkSession, sf_dir: str) -> Model:
    base = {name: Source.table(spark, name, f"{sf_dir}/{name}.parquet") for name in TABLES}
    extended = {
        "region": base["region"].extend(primary_key="r_regionkey", measures=[row_count()]),
        "nation": base["nation"].extend(
            primary_key="n_nationkey", measures=[row_count()],
            joins=[join_one("region", with_="n_regionkey")]),
        "customer": base["customer"].extend(
            primary_key="c_custkey",
            dimensions=[rename("segment", "c_mktsegment"), dim("in_debt", "c_acctbal < 0")],
            measures=[row_count(), *numeric_measures("c_acctbal", 2)],
            joins=[join_one("nation", with_="c_nationkey"), join_many("orders", [("c_custkey", "o_custkey")])]),
        "supplier": base["supplier"].extend(
            primary_key="s_suppkey", measures=[row_count(), *numeric_measures("s_acctbal", 2)],
            joins=[join_one("nation", with_="s_nationkey")]),
        "part": base["part"].extend(
            primary_key="p_partkey", measures=[row_count(), *numeric_measures("p_retailprice", 2)]),
        "orders": base["orders"].extend(
            primary_key="o_orderkey",
            dimensions=[rename("status", "o_orderstatus"), dim("order_year", "year(o_orderdate)"),
                        dim("is_open", "o_orderstatus = 'O'")],
            measures=[row_count(), *numeric_measures("o_totalprice", 2),
                      Measure("count_distinct_o_custkey", "count_distinct", "o_custkey")],
            joins=[join_one("customer", [("o_custkey", "c_custkey")]),
                   join_many("items", [("o_orderkey", "l_orderkey")], of="lineitem")]),
        "lineitem": base["lineitem"].extend(
            primary_key=["l_orderkey", "l_linenumber"],
            dimensions=[rename("return_flag", "l_returnflag"), dim("ship_year", "year(l_shipdate)"),
                        dim("net_price", "l_extendedprice * (1 - l_discount)"),
                        dim("ships_home", "orders.customer.c_nationkey = supplier.s_nationkey")],
            measures=[row_count(), *numeric_measures("l_quantity", 2), *numeric_measures("l_extendedprice", 2),
                      sum_alias("l_tax", 2), Measure("count_l_partkey", "count", "l_partkey"),
                      Measure("count_distinct_l_partkey", "count_distinct", "l_partkey"),
                      Measure("total_net_price", "sum", "net_price", 4), Measure("avg_net_price", "avg", "net_price", 4)],
            joins=[join_one("orders", [("l_orderkey", "o_orderkey")]), join_one("part", with_="l_partkey"),
                   join_one("supplier", with_="l_suppkey")]),
        "events": base["events"].extend(
            primary_key="event_id", measures=[row_count(), *numeric_measures("value", 2)],
            joins=[join_one("customer", [("user_id", "c_custkey")])]),
        "documents": base["documents"].extend(
            primary_key="doc_id", measures=[row_count(), *numeric_measures("n_chars")]),
        "labels": base["labels"].extend(
            primary_key="doc_id", measures=[row_count()], joins=[join_one("documents", with_="doc_id")]),
        "conversations": base["conversations"].extend(primary_key=["conv_id", "turn"], measures=[row_count()]),
        "pages": base["pages"].extend(primary_key="page_id", measures=[row_count()]),
        "benchmark": base["benchmark"].extend(primary_key="item_id", measures=[row_count()]),
        "embeddings": base["embeddings"].extend(primary_key="vec_id", measures=[row_count()]),
    }
    return Model.build(*extended.values())
