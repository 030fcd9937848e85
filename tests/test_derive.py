import json

import pytest
from fixtures import ACRONYM, CATALOGS, SNAKE
from pyspark.sql import functions as F

from semaspark.functions import naming
from semaspark.operators import derive as D
from semaspark.operators.composite import composite_refs, smallest_keys
from semaspark.operators.derive import build_model, derive_joins, derive_model
from semaspark.plans.query import run
from semaspark.sources import catalog as S
from semaspark.sources.catalog import catalog_from_frames


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "tables.json"
    path.write_text(json.dumps(CATALOGS))
    return S.read_catalog(spark, str(path))


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_names(spark):
    for mode, golden in (("compat", SNAKE), ("acronym", ACRONYM)):
        df = spark.createDataFrame([(k,) for k in golden], "n string").select("n", naming.snake_case(F.col("n"), mode).alias("s"))
        assert {r["n"]: r["s"] for r in df.collect()} == golden
    assert len(set(naming.RESERVED_WORDS)) == 118


def test_quoting(spark):
    yes = ["Home Town", "%x", "a(b)", "Year", "year", "1st", "a-b", "é b", "x]y", "#n"]
    no = ["Capacity", "_x", "a_b", "éa", "x.y", ""]
    df = spark.createDataFrame([(n,) for n in yes + no], "n string").select("n", naming.needs_quoting(F.col("n")).alias("q"))
    assert {r["n"] for r in df.collect() if r["q"]} == set(yes)


def test_catalog(catalog):
    odd = catalog.columns.filter("db_id = 'odd'")
    assert pairs(odd, "table_name", "col_idx", "column_name", "column_type")[0] == ("match_season", 4, "Team", "number")
    assert odd.count() == 5 and catalog.tables.filter("db_id = 'odd'").count() == 2
    assert pairs(catalog.last_key_column().filter("db_id = 'flights'"), "table_name", "column_name") == [
        ("airlines", "uid"), ("airports", "AirportCode"), ("flights", "FlightNo")]
    assert ("Friend", "friend_id", "Highschooler", "ID") in pairs(catalog.refs, "src_table", "src_column", "dst_table", "dst_column")


def test_missing_type_is_text(spark):
    raw = spark.sql("SELECT 'd' db_id, array('t') table_names_original, array(named_struct('table_idx', -1, 'name', '*'), "
                    "named_struct('table_idx', 0, 'name', 'x')) column_names_original, array('text') column_types, "
                    "array(1) primary_keys, array(named_struct('fk', 1, 'pk', 9)) foreign_keys")
    got = S.load_catalog(raw)
    assert pairs(got.columns, "column_name", "column_type") == [("x", "text")]
    assert got.refs.count() == 0 and got.keys.count() == 1


def test_joins(catalog):
    joins = D.derive_joins(catalog)

    def of(db):
        return pairs(joins.filter(F.col("db_id") == db), "source", "ref_no", "join_name", "target", "field", "target_field")

    assert of("flights") == [("flights", 0, "dest_airport_airports", "airports", "dest_airport", "airport_code"),
                             ("flights", 1, "source_airport_airports", "airports", "source_airport", "airport_code")]
    assert [r[2] for r in of("friends")] == ["friend_highschooler", "student_highschooler"]
    assert [r[2] for r in of("dogs")] == ["owner_owners", "owner_owners_2"]
    assert [r[2] for r in of("rooms")] == ["block_floor_block_val", "block_code_block_val"]
    assert of("self") == []
    assert [r[2] for r in of("odd")] == ["ref_team"]
    assert [r[2] for r in of("concert")] == ["stadium", "singer", "concert"]
    assert D.derive_joins(catalog, drop_duplicates=True).filter("db_id = 'dogs'").count() == 1


def test_alias_skips_columns(spark, catalog):
    taken = catalog.columns.filter("db_id = 'dogs'").limit(1).select(
        "db_id", F.lit(1).alias("table_idx"), F.lit("Dogs").alias("table_name"), F.lit(99).alias("col_idx"),
        F.lit("owner_owners_2").alias("column_name"), F.lit("text").alias("column_type"))
    more = S.Catalog(catalog.tables, catalog.columns.unionByName(taken), catalog.keys, catalog.refs)
    names = D.derive_joins(more).filter("db_id = 'dogs'").orderBy("ref_no").collect()
    assert [r["join_name"] for r in names] == ["owner_owners", "owner_owners_3"]


def test_levels(catalog):
    got = D.dependency_levels(catalog.tables, catalog.refs)
    rows = pairs(got.join(catalog.tables, ["db_id", "table_idx"]), "db_id", "table_name", "level", "cyclic")
    assert [r[1:] for r in rows if r[0] == "concert"] == [
        ("concert", 1, False), ("singer", 0, False), ("singer_in_concert", 2, False), ("stadium", 0, False)]
    assert all(r[3] for r in rows if r[0] == "cycle")
    assert {r[2] for r in rows if r[0] == "cycle"} == {0}
    assert [r[2:] for r in rows if r[0] == "self"] == [(0, False)]


def test_model(spark, catalog, tmp_path):
    model = D.derive_model(catalog)
    model.write(str(tmp_path / "m"))
    back = D.ModelTables.read(spark, str(tmp_path / "m"))
    assert pairs(back.dimensions.filter("db_id = 'odd'"), "source", "dimension", "column_name") == [
        ("match_season", "official_ratings", "Official_ratings_(millions)"), ("team", "change_2007", "%_Change_2007"),
        ("team", "home_town", "Home Town")]
    assert pairs(back.measures.filter("db_id = 'concert' and source = 'stadium'"), "measure") == [
        ("avg_capacity",), ("avg_stadium_i_d",), ("max_capacity",), ("max_stadium_i_d",), ("min_capacity",), ("min_stadium_i_d",),
        ("row_count",), ("total_capacity",), ("total_stadium_i_d",)]
    keys = {r["source"]: list(r["primary_key"]) for r in back.sources.filter("db_id in ('concert', 'flights', 'odd')").collect()}
    assert keys["stadium"] == ["stadium_i_d"] and keys["flights"] == ["Airline", "flight_no"] and keys["match_season"] == []
    frames = {
        "stadium": spark.sql("SELECT 1 Stadium_ID, 'X' Name, 500 Capacity"),
        "singer": spark.sql("SELECT 1 Singer_ID, 'A' Name, 30 Age"),
        "concert": spark.sql("SELECT 7 concert_ID, 1 Stadium_ID, 2014 Year"),
        "singer_in_concert": spark.sql("SELECT 7 concert_ID, 1 Singer_ID"),
    }
    built = D.build_model(back, "concert", frames)
    row = run(built, "singer_in_concert", group_by=["concert.stadium.name_val", ("singer_name", "singer.name_val")], aggregate=["row_count"]).head()
    assert tuple(row) == ("X", "A", 1)


def test_warnings(catalog):
    got = pairs(D.measure_warnings(catalog), "db_id", "source", "column_name", "reason")
    assert ("concert", "stadium", "Stadium_ID", "key") in got
    assert ("odd", "match_season", "Team", "reference") in got
    assert ("concert", "stadium", "Capacity", "key") not in got


def test_live_catalog(spark, sf):
    frames = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation", "customer")}
    live = S.catalog_from_frames(spark, frames, "sales", {"region": ["r_regionkey"], "nation": ["n_nationkey"]},
                                 [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])
    assert pairs(D.dependency_levels(live.tables, live.refs), "table_idx", "level") == [(0, 0), (1, 1), (2, 2)]
    model = D.build_model(D.derive_model(live), "sales", frames)
    out = run(model, "customer", group_by=["nation.region.r_name"], aggregate=["row_count"])
    assert out.agg(F.sum("row_count")).head()[0] == frames["customer"].count()


def test_schema_text(catalog):
    text = {r["db_id"]: r["schema_text"] for r in S.render_schema(catalog).collect()}
    assert text["dogs"] == ("Database: dogs\n\nTable: Owners\n  - owner_id (number)\n\nTable: Dogs\n  - dog_id (number)\n  - owner_id (number)\n\n"
                            "Primary Keys:\n  - Owners.owner_id\n  - Dogs.dog_id\n\n"
                            "Foreign Keys:\n  - Dogs.owner_id -> Owners.owner_id\n  - Dogs.owner_id -> Owners.owner_id")


def test_declared_model_as_tables(spark, sf):
    from semaspark.operators.coverage import element_counts
    from semaspark.plans.tpch import sales_model

    model = sales_model(spark, sf)
    row = element_counts(D.tables_of_model(spark, model, "sales")).head()
    assert row["sources"] == len(model.sources) == 14
    assert row["joins"] == sum(len(s.joins) for s in model.sources.values())
    assert row["measures"] == sum(len(s.measures) for s in model.sources.values())


def _catalog(spark, frames, keys, refs):
    return catalog_from_frames(spark, frames, "db", keys, refs)


def test_pairs_of_rooms_become_one_join(spark):
    block = spark.createDataFrame([(f, c, f"{f}{c}") for f in (1, 2, 3) for c in (1, 2)], "BlockFloor int, BlockCode int, label string")
    room = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 3, 2), (13, None, 1), (14, 9, 1)], "RoomNumber int, BlockFloor int, BlockCode int")
    frames = {"Block": block, "Room": room}
    catalog = _catalog(spark, frames, {"Block": ["BlockCode"], "Room": ["RoomNumber"]}, [("Room", "BlockFloor", "Block", "BlockFloor"), ("Room", "BlockCode", "Block", "BlockCode")])
    found = composite_refs(spark, catalog, lambda db, t: frames.get(t))
    assert [(r["refs"], r["n_rows"], r["n_found"]) for r in found.collect()] == [([0, 1], 4, 3)]
    joins = derive_joins(catalog, composites=found).collect()
    name = joins[0]["join_name"]
    assert len(joins) == 1 and joins[0]["field"].split(",") == joins[0]["target_field"].split(",") and joins[0]["field"].count(",") == 1
    assert derive_joins(catalog).count() == 2
    model = build_model(derive_model(catalog, composites=found), "db", frames)
    rows = run(model, "room", select=["RoomNumber", f"{name}.label"], order_by="RoomNumber").collect()
    assert [tuple(r) for r in rows] == [(10, "11"), (11, "12"), (12, "32"), (13, None), (14, None)]


def test_two_roles_are_told_apart_by_what_they_find(spark):
    block = spark.createDataFrame([(f, c) for f in range(1, 6) for c in range(1, 6) if (f + c) % 3], "f int, c int")
    calls = spark.createDataFrame([(1, 1, 5, 5), (2, 2, 4, 4), (1, 3, 2, 5), (5, 2, 1, 1), (4, 1, 2, 2)], "start_f int, end_c int, end_f int, start_c int").select("start_f", "end_c", "end_f", "start_c")
    swapped = spark.createDataFrame([(1, 4, 3, 1), (2, 3, 4, 2), (4, 5, 3, 1)], "start_f int, end_c int, end_f int, start_c int")
    refs = [("calls", "start_f", "block", "f"), ("calls", "end_c", "block", "c"), ("calls", "end_f", "block", "f"), ("calls", "start_c", "block", "c")]
    for source in (calls, swapped):
        frames = {"block": block, "calls": source}
        found = composite_refs(spark, _catalog(spark, frames, {"block": ["f", "c"]}, refs), lambda db, t: frames[t]).collect()
        there = {tuple(r) for r in block.collect()}
        rows = source.collect()
        hits = {(a, b): sum((r[a], r[b]) in there for r in rows) for a in ("start_f", "end_f") for b in ("start_c", "end_c")}
        best = max(hits.values())
        assert len(found) == 2 and found[0]["n_found"] == best
        assert sorted(c for r in found for c in r["src_columns"]) == ["end_c", "end_f", "start_c", "start_f"]
        for r in found:
            pair = sorted(r["src_columns"], key=lambda c: c[-1], reverse=True)
            assert hits[pair[0], pair[1]] == r["n_found"]


def test_a_column_that_is_a_key_alone_keeps_its_reference(spark):
    target = spark.createDataFrame([(1, 10), (2, 20)], "a int, b int")
    source = spark.createDataFrame([(1, 10)], "x int, y int")
    frames = {"t": target, "s": source}
    catalog = _catalog(spark, frames, {"t": ["a"]}, [("s", "x", "t", "a"), ("s", "y", "t", "b")])
    assert composite_refs(spark, catalog, lambda db, t: frames[t]).count() == 0
    assert composite_refs(spark, catalog, lambda db, t: None).count() == 0
    assert derive_joins(catalog, composites=composite_refs(spark, catalog, lambda db, t: frames[t])).count() == 2
    assert smallest_keys(spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 1, None)], "a int, b int, c int"), ["a", "b", "c"]) == [("a", "b", "c")]


def test_keys_and_ways_are_counted_by_type(spark):
    from semaspark.operators import composite
    frame = spark.createDataFrame([(1, 1, "1", 1.0), (2, None, "01", -0.0), (2, 2, "2", 0.0), (None, 2, "2", 0.0)], "a int, b long, c string, d double")
    assert [composite._kind(frame, c) for c in "abcd"] == ["bigint", "bigint", "string", "string"]
    assert smallest_keys(frame, ["a", "b", "d"]) == [("a", "b"), ("a", "d")]
    target = spark.createDataFrame([(1, "1"), (2, "2"), (2, "2")], "x short, y string")
    assert composite.inclusion_counts(frame, target, ("x", "y"), [("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]) == [(3, 2), (3, 3), (3, 2), (4, 0)]
