"""Result comparison: the inline cases of the evaluator, on single pairs and as one batch."""

import random

import pytest
from pyspark.sql import functions as F

from semaspark.functions.normalize import normalize_frame
from semaspark.operators import answers as A
from semaspark.operators import batch_compare as B
from semaspark.operators import compare as C

# name, left, right, ordered, match; None in place of rows means an empty result
CASES = [
    ("columns in another place", [("tea", 7, 0.5), ("oil", 3, 2.25)], [(0.5, "tea", 7), (2.25, "oil", 3)], False, True),
    ("two columns traded", [("north", 40), ("south", 12)], [(40, "north"), (12, "south")], False, True),
    ("nothing moved", [(70, 71), (80, 81), (90, 91)], [(70, 71), (80, 81), (90, 91)], False, True),
    ("no value shared", [(70, 71), (80, 81)], [(17, 18), (19, 20)], False, False),
    ("rows shuffled", [(9, "z"), (4, "m"), (6, "q"), (2, "k")], [(2, "k"), (9, "z"), (6, "q"), (4, "m")], False, True),
    ("rows shuffled, order counts", [(9, "z"), (4, "m"), (6, "q"), (2, "k")], [(2, "k"), (9, "z"), (6, "q"), (4, "m")], True, False),
    ("rows kept, order counts", [(9, "z"), (4, "m")], [(9, "z"), (4, "m")], True, True),
    ("repeats kept", [("up",), ("down",), ("up",), ("up",)], [("up",), ("up",), ("up",), ("down",)], False, True),
    ("one repeat too many", [("up",), ("up",), ("down",)], [("up",), ("down",), ("down",)], False, False),
    ("one value only", [(55,)] * 5, [(55,)] * 5, False, True),
    ("one value, other count", [(55,)] * 5, [(55,)] * 4, False, False),
    ("nothing on both sides", [], [], False, True),
    ("nothing on the left", [], [("x", 8)], False, False),
    ("nothing on the right", [("x", 8)], [], False, False),
    ("NULL in its place", [(None, 31), ("b7", None)], [(None, 31), ("b7", None)], False, True),
    ("NULL and text", [(31, None)], [(31, "none")], False, False),
    ("only NULLs", [(None, None, None)], [(None, None, None)], False, True),
    ("whole and fractional type", [(12, 600)], [(12.0, 600.0)], False, True),
    ("number and its text", [(12, 600)], [("12", "600")], False, True),
    ("twin columns", [(5, 5), (8, 8), (8, 8)], [(5, 5), (8, 8), (8, 8)], False, True),
    ("twin columns of text", [("ja", "ja"), ("no", "no")], [("ja", "ja"), ("no", "no")], False, True),
    ("six columns turned round", [(11, 22, 33, 44, 55, 66)], [(66, 55, 44, 33, 22, 11)], False, True),
    ("single column, order counts", [(8,), (3,), (5,)], [(5,), (8,), (3,)], True, False),
    ("equal value sets, other pairing", [(1, 2), (2, 1)], [(1, 1), (2, 2)], False, False),
    ("equal bags, other pairing", [(1, "a"), (2, "b")], [(1, "b"), (2, "a")], False, False),
    ("7 columns permuted", [(1, 2, 3, 4, 5, 6, 7), (8, 9, 10, 11, 12, 13, 14)],
     [(7, 6, 5, 4, 3, 2, 1), (14, 13, 12, 11, 10, 9, 8)], False, True),
    ("NULL in a permuted column", [(1, None), (2, "b")], [(None, 1), ("b", 2)], False, True),
    ("row counts differ", [(1, 2)], [(1, 2), (1, 2)], False, False),
    ("column counts differ", [(1, 2)], [(1,)], False, False),
    # needs the search: all columns hold the same bag, and the slot order is not the mapping
    ("cyclic columns", [(1, 2, 3), (2, 3, 1), (3, 1, 2), (1, 1, 2), (2, 2, 3), (3, 3, 1)],
     [(2, 1, 3), (3, 2, 1), (1, 3, 2), (1, 1, 2), (2, 2, 3), (3, 3, 1)], False, True),
    ("cyclic columns, no mapping", [(1, 2, 3), (2, 3, 1), (3, 1, 2)], [(1, 1, 1), (2, 2, 2), (3, 3, 3)], False, False),
    ("one-hot columns", [tuple(int(i == j) for j in range(5)) for i in range(5)],
     [tuple(int((i + 2) % 5 == j) for j in range(5)) for i in range(5)], True, True),
    ("search with order", [(1, 2), (2, 1), (1, 1), (2, 2)], [(2, 1), (1, 2), (1, 1), (2, 2)], True, True),
    ("search with order fails", [(1, 2), (2, 1), (1, 1), (2, 2)], [(2, 1), (1, 1), (1, 2), (2, 2)], True, False),
]


def frame(spark, rows, width):
    def kind(i):
        seen = {type(r[i]) for r in rows if r[i] is not None}
        return "string" if str in seen else "double" if float in seen else "bigint"

    schema = ", ".join(f"x{i} {kind(i)}" for i in range(width))
    return spark.createDataFrame(rows, schema)


def width(rows, other):
    return len(rows[0]) if rows else len(other[0]) if other else 1


@pytest.mark.parametrize("name,left,right,ordered,match", CASES, ids=[c[0] for c in CASES])
def test_result_equal(spark, name, left, right, ordered, match):
    a, b = frame(spark, left, width(left, right)), frame(spark, right, width(right, left))
    # one partition keeps the order of the literal rows
    assert C.result_equal(a.coalesce(1), b.coalesce(1), ordered) is match


def test_compare_batch(spark):
    cells, heads = [], []
    for q, (_, left, right, ordered, _) in enumerate(CASES):
        for side, rows in (("gold", left), ("pred", right)):
            heads.append((q, side, len(rows), len(rows[0]) if rows else 0, None, ordered))
            cells += [(q, side, i, j, None if v is None else str(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
    heads += [(900, "gold", 1, 1, None, False), (900, "pred", None, 0, "boom", False),
              (901, "gold", 0, 1, None, False), (901, "pred", 0, 2, None, False)]
    headers = spark.createDataFrame(heads, "question_id int, side string, n_rows bigint, n_cols int, error string, ordered boolean")
    long = spark.createDataFrame(cells, "question_id int, side string, row_no bigint, col_no int, value string")
    got = {r["question_id"]: (r["match"], r["error"]) for r in B.compare_batch(headers, long).collect()}
    for q, (name, *_, match) in enumerate(CASES):
        assert got[q] == (match, None), name
    assert got[900] == (False, "Predicted SQL error: boom")
    assert got[901] == (True, None)


NORMAL = [
    (5.0, "n:5"), (3.5, "n:3.5"), (1e22, "n:10000000000000000000000"), (float("inf"), "n:Infinity"), (-0.0, "n:0"),
    ("42", "n:42"), ("3.14", "n:3.14"), (None, None), ("hello", "s:hello"), (" 42 ", "n:42"), ("007", "n:7"), ("5d", "s:5d"),
    ("nan", "s:nan"), ("", "s:"), ("1e3", "n:1000"), ("-0.0", "n:0"), ("-0", "n:0"), ("+5", "n:5"), ("1_000", "n:1000"), ("1__0", "s:1__0"),
    ("12345678901234567890123", "n:12345678901234567890123"), ("Infinity", "n:Infinity"), ("-inf", "n:-Infinity"), ("1e22", "n:10000000000000000000000"),
    (".5", "n:0.5"), ("5.", "n:5"), (".", "s:."), ("1 2", "s:1 2"), (True, "n:1"),
]


@pytest.mark.parametrize("value,expected", NORMAL, ids=[repr(v) for v, _ in NORMAL])
def test_normalize(spark, value, expected):
    kind = {float: "double", bool: "boolean"}.get(type(value), "string")
    assert normalize_frame(spark.createDataFrame([(value,)], f"x {kind}")).head()[0] == expected


def test_whole_doubles_keep_all_digits(spark):
    rng = random.Random(7)
    values = [rng.choice((-1, 1)) * float(rng.randrange(10**e, 10 ** (e + 1))) for e in range(14, 38) for _ in range(20)]
    values += [float(2**k) for k in range(50, 126)] + [1234567890123456768.0, 2.0**63, -(2.0**63), 2.0**63 - 1024]
    frame = normalize_frame(spark.createDataFrame([(v, str(int(v))) for v in values], "x double, t string"))
    assert [tuple(r) for r in frame.collect()] == [(f"n:{int(v)}",) * 2 for v in values]


def test_normalize_keeps_small_numbers_apart(spark):
    values = ["1e-12", "0", "0.30000000000000004", "0.3"]
    got = normalize_frame(spark.createDataFrame([(v,) for v in values], "x string"))
    assert got.distinct().count() == 4
    exact = spark.sql("SELECT cast('0.1' as decimal(38,18)) a, cast('0.123456789012345678' as decimal(38,18)) b, cast('2.00' as decimal(9,2)) c")
    assert tuple(normalize_frame(exact).head()) == ("n:0.1", "n:0.123456789012345678", "n:2")


def test_digits(spark):
    a, b = spark.sql("SELECT 0.1D + 0.2D AS x"), spark.sql("SELECT 0.3D AS x")
    assert not C.result_equal(a, b)
    assert C.result_equal(a, b, digits=6)


def test_positions(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(
        "l_extendedprice", "l_orderkey", "l_linenumber")
    rows = C.with_positions(df).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    prices = [r["l_extendedprice"] for r in rows]
    assert prices == sorted(prices)


def test_random_shuffle_and_damage(spark, sf):
    rng = random.Random(5)
    df = spark.read.parquet(f"{sf}/orders.parquet")
    order = list(range(len(df.columns)))
    rng.shuffle(order)
    other = C.permute(df, order).orderBy(F.rand(3))
    assert C.result_equal(df, other)
    damaged = other.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 17, 0.0).otherwise(F.col("o_totalprice")))
    assert not C.result_equal(df, damaged)
    assert [r["status"] for r in C.diff_frames(df, damaged.select(*df.columns), ["o_orderkey"]).collect()] == ["changed"]
    assert C.diff_frames(df, damaged.select(*df.columns)).count() == 2


@pytest.fixture()
def people(spark):
    spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35)], "id int, name string, age int").createOrReplaceTempView("users")
    spark.createDataFrame([(1, 1, 100.0), (2, 1, 200.0), (3, 2, 150.0)], "id int, user_id int, amount double").createOrReplaceTempView("payments")


PAIRS = [
    ("SELECT name FROM users", "SELECT name FROM users", True),
    ("SELECT age, name FROM users", "SELECT name, age FROM users", True),
    ("SELECT name FROM users ORDER BY age DESC", "SELECT name FROM users", True),
    ("SELECT name FROM users ORDER BY age DESC", "SELECT name FROM users ORDER BY name", False),
    ("SELECT COUNT(*) FROM users", "SELECT COUNT(*) FROM users", True),
    ("SELECT name FROM users WHERE age > 30", "SELECT name FROM users WHERE age < 30", False),
    ("SELEC name FROM users", "SELECT name FROM users", False),
]


def test_compare_queries(spark, people):
    for predicted, gold, match in PAIRS:
        assert C.compare_queries(spark, predicted, gold).head()["match"] is match
    assert C.compare_queries(spark, "SELEC 1", "SELECT 1").head()["error"].startswith("Predicted SQL error")
    assert C.compare_queries(spark, "SELECT 1", "SELEC 1").head()["error"].startswith("Gold SQL error")
    assert C.compare_queries(spark, "SELECT 1 / (id - 1) FROM users", "SELECT 1").head()["error"]


@pytest.mark.parametrize("text", ["DROP VIEW kept", "CREATE OR REPLACE TEMP VIEW kept AS SELECT 2 AS x", "SET spark.sql.ansi.enabled=false", "CACHE TABLE kept"])
def test_only_queries_run(spark, text):
    spark.range(3).createOrReplaceTempView("kept")
    assert C.compare_queries(spark, text, "SELECT 1").head()["error"].startswith("Predicted SQL error")
    assert spark.table("kept").count() == 3 and not spark.catalog.isCached("kept")
    assert C.compare_queries(spark, "WITH a AS (SELECT id AS x, id FROM kept) SELECT * FROM a ORDER BY x; ", "SELECT id, id AS y FROM kept -- all").head()["match"]


def test_compare_pairs_is_the_same(spark, people):
    got = {r["question_id"]: r["match"] for r in A.compare_pairs(spark, [(i, p, g) for i, (p, g, _) in enumerate(PAIRS)]).collect()}
    assert [got[i] for i in range(len(PAIRS))] == [m for *_, m in PAIRS]


def test_self_check(spark, people):
    texts = ["SELECT name FROM users", "SELECT * FROM users ORDER BY age LIMIT 2", "SELECT name FROM users WHERE age > 99",
             "SELECT user_id, sum(amount) FROM payments GROUP BY user_id"]
    rows = A.self_check(spark, spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "question_id int, db_id string, sql string"), A.one_session(spark)).collect()
    assert len(rows) == 8
    assert all(r["match"] == (r["case"] == "same") for r in rows)


def test_order_matters(spark):
    rows = [("SELECT a FROM t ORDER BY a", True, True), ("SELECT a FROM t ORDER  BY a", False, True), ("SELECT 'order by' FROM t", True, False),
            ("SELECT a FROM (SELECT a FROM t ORDER BY a LIMIT 3) s", True, False), ("SELECT a FROM t", False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string")
    got = df.select(C.order_matters(F.col("q")), C.order_matters(F.col("q"), strict=True)).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "match boolean, error string")
    assert tuple(C.metrics(empty).head()) == (0, 0, 0, 0.0)


def test_candidates(spark):
    a = spark.createDataFrame([(1, "x", 7), (2, "y", 7)], "a int, b string, c int")
    b = spark.createDataFrame([("x", 7.0, "1"), ("y", 7.0, "2")], "a string, b double, c string")
    assert sorted(tuple(r) for r in C.column_candidates(a, b).collect()) == [(0, 2), (1, 0), (2, 1)]
    assert C.column_mapping(a, b) == [2, 0, 1]
    assert C.quick_reject(a, b.limit(1)) and not C.quick_reject(a, b)


def _sides(spark, gold, pred):
    rows = [(1, side, None, [str(v) for v in r]) for side, found in (("gold", gold), ("pred", pred)) for r in found]
    return spark.createDataFrame(rows, "question_id int, side string, pos long, vals array<string>")


def _alike(spark, n):
    return spark.createDataFrame([(1, [0] * n)], "question_id int, classes array<int>")


def test_colours_settle_twelve_alike_columns_in_one_round(spark):
    gold = [[(r * (c + 1)) % 37 for c in range(12)] for r in range(37)]
    order = [7, 3, 11, 0, 9, 5, 1, 10, 2, 8, 6, 4]
    rows = _sides(spark, gold, [[r[c] for c in order] for r in gold])
    colours, rounds = B.refine(rows, _alike(spark, 12))
    assert rounds == 2  # one that tells all columns apart, and one that changes nothing
    by = {(r["side"], r["col_no"]): r["fp"] for r in colours.collect()}
    assert len({v for (s, _), v in by.items() if s == "gold"}) == 12
    assert all(by["pred", i] == by["gold", c] for i, c in enumerate(order))
    assert B.resolve(rows, _alike(spark, 12)).count() == 1
    turned = [[(v + (c == 4)) % 37 for c, v in enumerate(r)] for r in gold]
    assert B.resolve(_sides(spark, gold, [[r[c] for c in order] for r in turned]), _alike(spark, 12)).count() == 0


def test_equal_columns_are_one_and_symmetric_ones_are_searched(spark):
    # All columns can stand for each other: colours stay, one choice settles the rest.
    gold = [[(r * c) % 5 for c in (1, 2, 3, 4)] for r in range(5)]
    pred = [[r[c] for c in (2, 0, 3, 1)] for r in gold]
    assert B.refine(_sides(spark, gold, pred), _alike(spark, 4))[0].select("fp").distinct().count() == 1
    assert B.resolve(_sides(spark, gold, pred), _alike(spark, 4)).count() == 1
    shifted = [[(v + (c == 0)) % 5 for c, v in enumerate(r)] for r in pred]
    assert B.resolve(_sides(spark, gold, shifted), _alike(spark, 4)).count() == 0
    # Nine equal columns beside two others: without merging, 9! orders are alike.
    gold = [[v] * 9 + [(v * 2) % 7, (v * 3) % 7] for v in range(7)]
    pred = [[r[10], *r[:4], r[9], *r[4:9]] for r in gold]
    colours, _ = B.refine(_sides(spark, gold, pred), _alike(spark, 11))
    assert colours.count() == 6
    assert B.resolve(_sides(spark, gold, pred), _alike(spark, 11)).count() == 1
    fewer = [[v] * 8 + [(v * 2) % 7] * 2 + [(v * 3) % 7] for v in range(7)]
    assert B.resolve(_sides(spark, gold, fewer), _alike(spark, 11)).count() == 0


def test_bags_and_diffs_of_unlike_types_and_maps(spark):
    numbers = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v long")
    texts = spark.createDataFrame([("1", "5.0"), (" 2", None), ("3", "x")], "k string, v string")
    assert not C.bag_equal(numbers, texts)
    assert C.bag_equal(numbers.filter("k < 3"), texts.filter("v is null or v <> 'x'")) and not C.bag_equal(numbers, spark.createDataFrame([("x", "y")], "a string, b string"))
    assert sorted(map(tuple, C.diff_frames(numbers, texts).collect())) == [("3", "7", 1, 0), ("3", "x", 0, 1)]
    assert [tuple(r) for r in C.diff_frames(numbers, texts, ["k"]).collect()] == [("3", "changed", "v")]

    nested = "k int, m map<string,array<int>>, s struct<a: int, b: map<int,string>>"
    a = spark.createDataFrame([(1, {"x": [1, 2], "y": []}, (1, {1: "p", 2: None})), (2, None, None), (3, {"z": None}, (None, {}))], nested)
    b = spark.createDataFrame([(3, {"z": None}, (None, {})), (1, {"y": [], "x": [1, 2]}, (1, {2: None, 1: "p"})), (2, None, None)], nested)
    assert C.bag_equal(a, b) and C.diff_frames(a, b).count() == 0 and C.diff_frames(a, b, ["k"]).count() == 0 and C.result_equal(a, b)
    c = spark.createDataFrame([(1, {"y": [], "x": [2, 1]}, (1, {2: None, 1: "p"})), (2, {}, None), (3, {"z": None}, (None, {3: "q"}))], nested)
    assert not C.bag_equal(a, c) and not C.result_equal(a, c)
    assert sorted(map(tuple, C.diff_frames(a, c, ["k"]).collect())) == [(1, "changed", "m"), (2, "changed", "m"), (3, "changed", "s")]
    assert C.diff_frames(a, c).count() == 6
    with pytest.raises(ValueError, match="columns"):
        C.diff_frames(a, numbers)


def test_doubles_of_any_size_have_all_their_digits(spark):
    values = [1e38, 1e39, -1e39, 1e300, 1.7976931348623157e308, 2.0**127, 2.0**128 - 2.0**75, 3e200, 123456789e50]
    df = spark.createDataFrame([(v, str(int(v)), "  +" + str(int(v)) if v > 0 else str(int(v)), repr(v)) for v in values], "d double, t string, u string, e string")
    for row in normalize_frame(df).collect():
        assert len(set(row)) == 1 and row[0].startswith("n:") and "E" not in row[0]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (float("-inf"),)], "d double")
    assert [r[0] for r in normalize_frame(odd).collect()] == ["n:Infinity", "n:NaN", "n:-Infinity"]
    assert C.result_equal(df.select("d"), df.select("t")) and not C.result_equal(df.select("d"), df.select((F.col("d") * 2).alias("t")))


def test_rows_of_a_wrong_guess_are_not_dealt_by_value(spark, monkeypatch):
    from semaspark.operators import batch_compare as B

    def side(q, name, rows):
        return [(q, name, i, list(r)) for i, r in enumerate(rows)]

    gold = [("x", "y", "0"), ("y", "x", "1"), ("u", "v", "0"), ("v", "u", "1")]
    turned = [(b, a, c) for a, b, c in gold]
    mixed = gold[:2] + turned[2:]
    rows = spark.createDataFrame([r for q, pred in (("same", gold), ("turned", turned), ("mixed", mixed)) for r in side(q, "gold", gold) + side(q, "pred", pred)],
                                 "question_id string, side string, pos long, vals array<string>").withColumn("pos", F.xxhash64("vals"))
    heads = rows.groupBy("question_id", "side").agg(F.count("*").alias("n_rows"), F.lit(3).alias("n_cols"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("ordered"))
    dealt, real = [], B.equal_bags
    monkeypatch.setattr(B, "equal_bags", lambda placed: dealt.append({r[0] for r in placed.select("question_id").distinct().collect()}) or real(placed))
    assert {r["question_id"]: r["match"] for r in B.compare_rows(heads, rows).collect()} == {"same": True, "turned": True, "mixed": False}
    assert len(dealt[0]) < 3 and "mixed" not in dealt[0]
    made = B._pair_prints(rows.select("question_id", "side", "pos", F.concat("vals", "vals", "vals").alias("vals")))
    assert {(r["i"], r["j"]) for r in made.select("i", "j").distinct().collect()} == {(i, j) for i in range(9) for j in range(9) if i != j}
