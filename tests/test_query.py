import pytest
from pyspark.sql import functions as F

from semaspark.plans import relations as R
from semaspark.plans.model import (Measure, Model, ModelError, Source, dim, join_many, join_one, measure, mentioned, rename, resolve_paths,
                                   row_count, split_path)
from semaspark.plans.query import run


@pytest.fixture(scope="module")
def model(spark):
    shops = spark.createDataFrame([(1, "north", 10.0), (2, "south", 20.0), (3, "south", None)], "id int, area string, rent double")
    sales = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 2, 1), (4, None, 2), (5, 9, 4)], "sale int, shop int, qty int")
    visits = spark.createDataFrame([(1,), (1,), (2,), (2,), (2,)], "shop int")
    return Model.build(
        Source.of("shops", shops).extend(
            primary_key="id", dimensions=[rename("region", "area"), dim("pricey", "rent > 15")],
            measures=[row_count(), measure("sum", "rent", scale=2), measure("avg", "rent")],
            joins=[join_many("sales", [("id", "shop")]), join_many("visits", [("id", "shop")])]),
        Source.of("sales", sales).extend(
            primary_key="sale", dimensions=[dim("where_sold", "coalesce(shops.region, 'nowhere')"), dim("loud", "upper(where_sold)")][:1],
            measures=[row_count(), measure("sum", "qty"), measure("max", "qty"), Measure("kinds", "count_distinct", "qty"),
                      Measure("south_qty", "sum", "CASE WHEN where_sold = 'south' THEN qty END")],
            joins=[join_one("shops", with_="shop")]),
        Source.of("visits", visits).extend(measures=[row_count()]))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_left_join_keeps_unmatched(model):
    out = run(model, "sales", group_by=["where_sold"], aggregate=["row_count", "total_qty"], order_by="where_sold")
    assert rows(out) == [("north", 2, 12), ("nowhere", 2, 6), ("south", 1, 1)]
    assert rows(run(model, "sales", aggregate=["south_qty"])) == [(1,)]


def test_no_join_without_use(model):
    plan = run(model, "sales", aggregate=["row_count", "total_qty"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plan = run(model, "sales", group_by=["shops.region"], aggregate=["row_count"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_two_many_joins_do_not_multiply(model):
    out = run(model, "shops", group_by=["region"], aggregate=[
        "row_count", "total_rent", ("n_sales", "sales.row_count"), "sales.total_qty", "sales.max_qty", ("n_visits", "visits.row_count")], order_by="region")
    assert rows(out) == [("north", 1, 10.0, 2, 12, 7, 2), ("south", 2, 20.0, 1, 1, 1, 3)]


def test_many_side_distinct_and_filters(model):
    assert rows(run(model, "shops", aggregate=["row_count", "sales.kinds"])) == [(3, 3)]
    assert rows(run(model, "shops", aggregate=["row_count", "sales.total_qty"], where="sales.qty > 5")) == [(1, 7)]
    with pytest.raises(ModelError, match="without a match"):
        run(model, "shops", aggregate=["row_count"], where="sales.qty is null")


def test_one_side_measure_counts_each_row_once(model):
    assert rows(run(model, "sales", aggregate=["row_count", "shops.total_rent"])) == [(5, 30.0)]
    out = run(model, "sales", group_by=["shops.region"], aggregate=["shops.avg_rent", "row_count"], order_by="region")
    assert rows(out) == [("north", 10.0, 2), ("south", 20.0, 1), (None, None, 2)]


def test_select_order_limit(model):
    out = run(model, "sales", select=["sale", ("place", "shops.region")], order_by=["place", "-sale"], limit=3)
    assert rows(out) == [(2, "north"), (1, "north"), (3, "south")]
    first = run(model, "sales", select=["sale", "shops.region"], order_by="region", nulls="first", limit=1)
    assert first.head()["region"] is None
    assert rows(run(model, "sales", select=["shops.region"], distinct=True, order_by="region")) == [("north",), ("south",), (None,)]
    assert run(model, "shops", select="*").columns == ["id", "area", "rent", "region", "pricey"]


def test_having_and_errors(model):
    assert rows(run(model, "sales", group_by=["shop"], aggregate=["total_qty"], having="total_qty > 5")) == [(1, 12)]
    for bad in (dict(group_by=["nope"]), dict(aggregate=["nope"]), dict(group_by=["nope.x"]), dict(), dict(select=["sale"], group_by=["sale"]),
                dict(group_by=["shop"], order_by="qty"), dict(aggregate=["row_count", "shops.row_count"]), dict(aggregate=["row_count"], on_violation="x")):
        with pytest.raises(ModelError):
            run(model, "sales", **bad)


def test_false_key_policies(spark):
    codes = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three")], "code string, label string")
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "code string, v int")
    m = Model.build(Source.of("codes", codes), Source.of("facts", facts).extend(measures=[row_count()], joins=[join_one("codes", [("code", "code")])]))
    ask = dict(group_by=["codes.label"], aggregate=["row_count"], order_by="label")
    assert rows(run(m, "facts", **ask, on_violation="trust")) == [("one", 1), ("three", 1), ("two", 1)]
    with pytest.raises(Exception, match="two rows for key a"):
        run(m, "facts", **ask).collect()
    keyed = Model.build(Source.of("codes", codes).extend(primary_key="code"), m.source("facts"))
    assert len(rows(run(keyed, "facts", **ask))) == 3
    assert rows(run(m, "facts", **ask, on_violation="dedupe")) == [("one", 1), ("three", 1)]
    with pytest.raises(Exception, match="two rows for key a"):
        run(m, "facts", **ask, on_violation="error").collect()


def test_declarations(spark, model):
    one = spark.range(1)
    with pytest.raises(ModelError, match="collides"):
        run(Model.build(Source.of("x", one).extend(dimensions=[dim("ID", "id")], measures=[row_count()])), "x", aggregate=["row_count"])
    with pytest.raises(ModelError, match="primary key"):
        Model.build(Source.of("x", one), Source.of("y", one).extend(joins=[join_one("x", with_="id")]))
    with pytest.raises(ModelError):
        join_one("x")
    with pytest.raises(ModelError):
        Measure("m", "median", "x")
    with pytest.raises(ModelError):
        model.source("nope")


def test_paths_in_expressions(model):
    sales = model.source("sales")
    text, used = resolve_paths(sales, "shops.region = 'shops.region' and x.y > 1.5 and shops.`odd name` is null")
    assert text == "`shops.region` = 'shops.region' and x.y > 1.5 and `shops.odd name` is null"
    assert used == {("shops", "region"), ("shops", "odd name")}
    assert split_path("a.`b c`.d") == (("a", "b c"), "d")
    assert mentioned(sales, "where_sold = 'x'") == ["where_sold"] and mentioned(sales, "x = 'where_sold'") == []


def test_not_in_keeps_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some, gap, none = (spark.createDataFrame([(v,) for v in vs], "o int") for vs in ([2], [2, None], []))
    on = [("k", "o")]
    assert rows(R.where_not_in(left, some, on, null_aware=True)) == [(1,)]
    assert rows(R.where_not_in(left, gap, on, null_aware=True)) == []
    assert len(rows(R.where_not_in(left, none, on, null_aware=True))) == 3
    assert sorted(rows(R.where_not_in(left, some, on)), key=str) == [(1,), (None,)]


def test_run_sql(spark):
    assert rows(R.run_sql(spark, "SELECT sum(id) FROM numbers", numbers=spark.range(4))) == [(6,)]


def test_sums_do_not_depend_on_order(spark, sf):
    from semaspark.functions.exact import exact_sum
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    totals = {lines.repartition(n).agg(exact_sum(F.col("l_extendedprice")).alias("s")).head()["s"] for n in (1, 3, 7)}
    assert len(totals) == 1


@pytest.fixture(scope="module")
def nested(spark):
    """Regions have towns, towns have shops and fairs, shops have sales; a sale has one item, a shop one owner."""
    def source(name, rows, schema, **more):
        return Source.of(name, spark.createDataFrame(rows, schema)).extend(**more)

    return Model.build(
        source("regions", [(1, "n", 10), (2, "s", 20), (3, "e", 5)], "r int, rn string, size int", primary_key="r", measures=[row_count(), measure("sum", "size")],
               joins=[join_many("towns", [("r", "tr")])]),
        source("towns", [(1, 1, 7), (2, 1, 8), (3, 2, 9)], "t int, tr int, pop int", primary_key="t", measures=[row_count(), measure("sum", "pop"), Measure("pops", "count_distinct", "pop")],
               joins=[join_many("shops", [("t", "st")]), join_many("fairs", [("t", "ft")])]),
        source("fairs", [(1, 100), (1, 200), (3, 300)], "ft int, guests int", measures=[row_count(), measure("sum", "guests")]),
        source("shops", [(1, 1, "x", 1), (2, 1, "y", 2), (3, 3, "x", 1), (4, 2, "z", None)], "s int, st int, kind string, own int", primary_key="s", measures=[row_count()],
               joins=[join_many("sales", [("s", "sh")]), join_one("owners", with_="own")]),
        source("owners", [(1, 50), (2, 60)], "o int, age int", primary_key="o", measures=[row_count(), measure("sum", "age")], joins=[join_many("pets", [("o", "po")])]),
        source("pets", [(1, 3), (1, 4), (2, 5)], "po int, legs int", measures=[row_count(), measure("sum", "legs")]),
        source("sales", [(1, 2, "a"), (1, 3, "a"), (2, 4, "b"), (3, 9, "a"), (3, 1, "c")], "sh int, qty int, item string", measures=[row_count(), measure("sum", "qty"), measure("avg", "qty"), Measure("items", "count_distinct", "item")],
               joins=[join_one("items", with_="item")]),
        source("items", [("a", 5), ("b", 6), ("c", 7)], "i string, price int", primary_key="i", measures=[row_count(), measure("sum", "price")]))


def test_measures_through_three_levels(nested):
    ask = ["row_count", "total_size", ("towns", "towns.row_count"), "towns.total_pop", ("shops", "towns.shops.row_count"), ("sales", "towns.shops.sales.row_count"),
           "towns.shops.sales.total_qty", "towns.shops.sales.avg_qty", ("fairs", "towns.fairs.row_count"), "towns.fairs.total_guests"]
    assert rows(run(nested, "regions", aggregate=ask)) == [(3, 35, 3, 24, 4, 5, 19, 19 / 5, 3, 600)]
    assert rows(run(nested, "regions", group_by=["rn"], aggregate=ask, order_by="rn")) == [
        ("e", 1, 5, 0, None, 0, 0, None, None, 0, None), ("n", 1, 10, 2, 15, 3, 3, 9, 3.0, 2, 300), ("s", 1, 20, 1, 9, 1, 2, 10, 5.0, 1, 300)]


def test_rows_above_count_once_per_group_below(nested):
    ask = ["row_count", "total_size", "towns.total_pop", ("shops", "towns.shops.row_count"), "towns.shops.sales.total_qty", "towns.fairs.total_guests"]
    out = run(nested, "regions", group_by=["towns.shops.sales.item"], aggregate=ask, order_by="item")
    assert rows(out) == [("a", 2, 30, 16, 2, 14, 600), ("b", 1, 10, 7, 1, 4, 300), ("c", 1, 20, 9, 1, 1, 300), (None, 2, 15, 8, 1, None, None)]


def test_distinct_and_one_side_measures_at_any_depth(nested):
    out = run(nested, "regions", group_by=["rn"], aggregate=["towns.pops", "towns.shops.sales.items", ("n_items", "towns.shops.sales.items.row_count"), "towns.shops.sales.items.total_price",
                                                            "towns.shops.owners.total_age", ("pets", "towns.shops.owners.pets.row_count"), "towns.shops.owners.pets.total_legs", "row_count"], order_by="rn")
    assert rows(out) == [("e", 0, 0, 0, None, None, 0, None, 1), ("n", 2, 2, 2, 11, 110, 3, 12, 1), ("s", 1, 2, 2, 12, 50, 2, 7, 1)]
    assert rows(run(nested, "shops", aggregate=["row_count", "owners.total_age", ("pets", "owners.pets.row_count")])) == [(4, 110, 3)]
    assert rows(run(nested, "shops", group_by=["owners.pets.legs"], aggregate=["row_count", "owners.total_age"], order_by="legs")) == [(3, 2, 50), (4, 2, 50), (5, 1, 60), (None, 1, None)]


def test_conditions_at_any_depth(nested):
    ask = dict(aggregate=["row_count", "towns.total_pop", "towns.shops.sales.total_qty"])
    assert rows(run(nested, "regions", **ask, where="towns.shops.sales.qty > 3")) == [(2, 16, 13)]
    assert rows(run(nested, "regions", **ask, where="towns.shops.sales.qty > towns.pop")) == [(0, None, None)]
    assert rows(run(nested, "regions", **ask, where="towns.shops.sales.qty * 3 > towns.pop + size / 10")) == [(2, 16, 16)]
    assert rows(run(nested, "regions", **ask, where=["towns.shops.sales.qty * 3 > towns.pop", "towns.shops.kind = 'x'", "rn <> 's'"])) == [(1, 7, 3)]
    assert rows(run(nested, "regions", **ask, where="towns.shops.sales.items.price + towns.shops.owners.age < 56")) == [(2, 16, 14)]
    assert rows(run(nested, "shops", aggregate=["row_count", ("pets", "owners.pets.row_count")], where="owners.pets.legs = 4")) == [(2, 1)]
    with pytest.raises(ModelError, match="one condition per"):
        run(nested, "regions", **ask, where="towns.shops.s > towns.fairs.guests")
    with pytest.raises(ModelError, match="without a match"):
        run(nested, "regions", **ask, where="towns.shops.sales.qty is null")
    with pytest.raises(ModelError, match="cannot reach"):
        run(nested, "shops", aggregate=["row_count"], where="owners.pets.legs > s")


def test_rows_of_nested_sides(nested):
    out = run(nested, "regions", select=["rn", "towns.t", "towns.shops.sales.qty"], where="towns.shops.sales.qty > size / 10", order_by=["t", "qty"])
    assert rows(out) == [("n", 1, 2), ("n", 1, 3), ("n", 1, 4), ("s", 3, 9)]


def test_each_table_of_a_plan_is_read_once(spark, sf):
    from semaspark.plans.tpch import sales_model

    out = run(sales_model(spark, sf), "customer", group_by=["segment"], aggregate=["row_count", "orders.total_o_totalprice", "orders.items.total_l_quantity", ("n", "orders.items.row_count")],
              where="orders.items.l_discount < 0.05")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 3 and plan.count("Join") == 2
    out = run(sales_model(spark, sf), "lineitem", group_by=["return_flag"], aggregate=["orders.customer.row_count", ("balance", "orders.customer.total_c_acctbal"), ("least", "orders.customer.min_c_acctbal")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3


def test_dimensions_stay_on_the_one_side(nested):
    bad = nested.source("regions").extend(dimensions=[dim("x", "towns.pop + 1")])
    with pytest.raises(ModelError, match="one-to-many"):
        run(Model({**nested.sources, "regions": bad}), "regions", group_by=["x"], aggregate=["row_count"])
