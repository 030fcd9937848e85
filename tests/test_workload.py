import json

import pytest
from fixtures import CATALOGS

from semaspark.operators import workload as W
from semaspark.sources import catalog as S

LOG = [
    ("concert", "SELECT COUNT(Age), avg(Capacity) FROM singer, stadium"),
    ("concert", "SELECT T2.Name, count(*) FROM singer_in_concert AS T1 JOIN singer AS T2 ON T1.Singer_ID = T2.Singer_ID GROUP BY T2.Name"),
    ("concert", "SELECT COUNT(DISTINCT Name) FROM singer"),
    ("concert", "select * from concert join stadium on concert.Stadium_ID = stadium.Stadium_ID"),
    ("concert", "SELECT x FROM singers WHERE Capacity > 1"),
    ("odd", "SELECT sum(Official_ratings_(millions)), `Home Town` FROM team"),
    ("odd", "SELECT max(2%_Change_2007) FROM match_season JOIN team ON 1 = 1"),
    ("odd", "SELECT discount (Team_id) FROM team"),
    ("nowhere", "SELECT 1"),
    ("nowhere", "SELECT 1"),
]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "tables.json"
    path.write_text(json.dumps(CATALOGS))
    log = spark.createDataFrame(LOG, "db_id string, query string")
    return log, S.read_catalog(spark, str(path))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_used(inputs):
    log, catalog = inputs
    q = W.distinct_queries(log)
    assert rows(W.tables_used(q, catalog)) == [
        ("concert", "concert"), ("concert", "singer"), ("concert", "singer_in_concert"), ("concert", "stadium"),
        ("odd", "match_season"), ("odd", "team")]
    columns = rows(W.columns_used(q, catalog))
    assert ("odd", "team", "home town") in columns and ("odd", "team", "%_change_2007") in columns
    assert ("concert", "stadium", "capacity") in columns
    # ends in a parenthesis: no word boundary after it
    assert not any(c[2].startswith("official") for c in columns)
    assert rows(W.aggregates_used(q, catalog)) == [
        ("concert", "singer", "count", "age"), ("concert", "singer", "count", "name"), ("concert", "stadium", "avg", "capacity"),
        ("odd", "team", "count", "team_id"), ("odd", "team", "max", "%_change_2007")]


def test_joins(inputs):
    log, catalog = inputs
    q = W.distinct_queries(log)
    by_name = ("concert", "concert", "stadium_id", "stadium", "stadium_id")
    assert rows(W.joins_used(q, catalog)) == [by_name]
    assert rows(W.joins_used(q, catalog, resolve_aliases=True)) == [
        by_name, ("concert", "singer", "singer_id", "singer_in_concert", "singer_id")]


def test_alias_is_not_a_clause_word(spark, inputs):
    _, catalog = inputs
    log = spark.createDataFrame([("concert", "select 1 from singer join concert c on singer.a = c.b"),
                                 ("concert", "select 1 from stadium s join singer t on t.z = s.y")], "db_id string, query string")
    assert rows(W.joins_used(W.distinct_queries(log), catalog, resolve_aliases=True)) == [
        ("concert", "concert", "b", "singer", "a"), ("concert", "singer", "z", "stadium", "y")]


def test_report_and_summary(inputs):
    log, catalog = inputs
    report = {r["db_id"]: r for r in W.analysis_report(log, catalog).collect()}
    assert set(report) == {"concert", "odd"}
    concert = report["concert"]
    assert concert["query_count"] == 5 and concert["tables_used"] == ["concert", "singer", "singer_in_concert", "stadium"]
    assert ("singer", ["age", "name", "singer_id"]) in [tuple(d) for d in concert["dimensions"]]
    assert ("stadium", "avg", ["capacity"]) in [tuple(m) for m in concert["measures"]]
    assert tuple(W.log_summary(log, catalog).head()) == (2, 1, 8)


def test_minimal(inputs):
    log, catalog = inputs
    sources, dims, measures = W.derive_minimal(log, catalog)
    assert ("odd", "team", "home town", "Home Town") in rows(dims)
    got = {(r["db_id"], r["source"], r["measure"]) for r in measures.collect()}
    assert ("concert", "singer", "row_count") in got and ("concert", "stadium", "avg_capacity") in got
    assert sources.count() == 6


def test_names_of_any_shape(spark):
    log = spark.createDataFrame([("d", r"select a\Eb, x%y from t")], "db_id string, query string")
    raw = spark.createDataFrame([("d", ["t"], [(0, "a\\Eb"), (0, "%"), (0, "%y")], ["text"] * 3, [], [])],
                                "db_id string, table_names_original array<string>, column_names_original array<struct<table_idx:int,name:string>>, "
                                "column_types array<string>, primary_keys array<int>, foreign_keys array<struct<fk:int,pk:int>>")
    got = rows(W.columns_used(W.distinct_queries(log), S.load_catalog(raw)))
    assert [r[2] for r in got] == ["%", "%y", "a\\eb"]


SCOPES = [
    ("select * from a x, b y where x.i = y.j", [("a", "i", "b", "j")]),
    ("select * from a, b as y, c where a.i = y.j and c.k = a.i", [("a", "i", "b", "j"), ("c", "k", "a", "i")]),
    ("select * from a t join b u on t.i = u.j where t.i in (select t.k from c t join d u on t.k = u.l)", [("a", "i", "b", "j"), ("c", "k", "d", "l")]),
    ("select * from a t where exists (select 1 from b u where u.j = t.i)", [("b", "j", "a", "i")]),
    ("select t.i from a t join b u on t.i = u.j union all select t.k from c t join d u on t.k = u.l", [("a", "i", "b", "j"), ("c", "k", "d", "l")]),
    ("select * from (select i from a) t join b u on t.i = u.j", [("", "i", "b", "j")]),
    ("select * from (a t join b u on t.i = u.j) left join c on u.j = c.k", [("a", "i", "b", "j"), ("b", "j", "c", "k")]),
    ("select (select max(u.j) from b u where u.j = t.i) from a t", [("b", "j", "a", "i")]),
    ("select 'from x t, y' , \"from z t\" from a t /* join q u */ join b u -- on t.z = u.z\n on t.i = u.j", [("a", "i", "b", "j")]),
    ("with w as (select t.i from a t join b u on t.i = u.j) select * from w t join c u on t.i = u.k", [("a", "i", "b", "j"), ("w", "i", "c", "k")]),
    ("select count(t.i, t.j) from a t natural join b where t.i >= b.j and t.i != b.j and t.i == b.j group by t.i, b.j", [("a", "i", "b", "j")]),
    ("select * from main.a t cross join other.b where t.i = b.j order by t.i, b.j limit 3, 4", [("a", "i", "b", "j")]),
    ("select x.i = y.j from nothing", [("x", "i", "y", "j")]),
    ("select ) ) from a t where t.i = t.j", [("a", "i", "a", "j")]),
    ("", []),
]


def test_aliases_mean_the_nearest_scope(spark):
    from pyspark.sql import functions as F

    from semaspark.functions.scopes import equalities

    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCOPES)] + [(-1, None)], "i int, sql string")
    got = {r["i"]: r["e"] for r in df.select("i", equalities(F.col("sql")).alias("e")).collect()}
    assert got[-1] is None
    for i, (text, want) in enumerate(SCOPES):
        assert [(e["t1"], e["c1"], e["t2"], e["c2"]) for e in got[i]] == [([a], b, [c], d) for a, b, c, d in want], text


def test_a_report_reads_the_log_once(inputs):
    log, catalog = inputs
    plan = W.analysis_report(log, catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[db_id#") and plan.count("query#") >= 1
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # the log and the staged names
    assert plan.count("Join") == 1


def test_names_that_are_too_many_to_send_are_salted(inputs, monkeypatch):
    log, catalog = inputs
    q = W.distinct_queries(log)
    sent = rows(W.columns_used(q, catalog)), rows(W.aggregates_used(q, catalog))
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    assert (rows(W.columns_used(q, catalog)), rows(W.aggregates_used(q, catalog))) == sent


def test_many_names_are_not_broadcast(inputs, monkeypatch):
    """Names beyond the limit meet the texts in a sorted join: with their salts they would not fit into the driver."""
    log, catalog = inputs
    few = rows(W.tables_used(W.distinct_queries(log), catalog))
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    many = W.tables_used(W.distinct_queries(log), catalog)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows(many) == few


def test_names_of_a_text_are_decided_once(inputs):
    log, catalog = inputs
    plan = W.tables_used(W.distinct_queries(log), catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("size(transform") == 0 and plan.count("filter(names") == 1
