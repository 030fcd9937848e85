import datetime as dt
import json
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from semaspark.operators import audit as V
from semaspark.operators import cost as P
from semaspark.operators import coverage as C
from semaspark.operators import evaluate as X
from semaspark.operators import selection
from semaspark.operators.selection import exact_percentiles, first_per_group, pareto
from semaspark.plans.model import Model, Source, row_count
from semaspark.session import sized
from semaspark.sources import records as R
from semaspark.streaming import metrics as S

TABLE, NESTED = ["table_unit", 1], ["sql", {"from": {}}]


def ast(units=(TABLE,), where=(), group=(), order=(), having=(), **sets):
    return json.dumps({"from": {"table_units": list(units), "conds": []}, "where": list(where), "groupBy": list(group), "orderBy": list(order),
                       "having": list(having), "union": None, "intersect": None, "except": None, **sets})


CLASSES = [
    (ast(), "easy"), (ast(where=[[False, 2, [0], 'a "{" b', None]]), "easy"), (ast(where=[[False, 2, [0], "\\\"{", None]]), "easy"),
    (ast(units=[TABLE, TABLE]), "medium"), (ast(order=["asc", [1]]), "medium"), (ast(group=[[1]]), "medium"), (ast(having=[[1]]), "medium"),
    (ast(units=[TABLE, TABLE], group=[[1]]), "hard"), (ast(units=[NESTED]), "hard"), (ast(where=[[False, 2, [0], {"select": []}, None]]), "hard"),
    (ast(union={"select": []}), "extra"), (ast(intersect={"x": 1}, group=[[1]]), "extra"), (ast(**{"except": {"x": 1}}), "extra"),
    (ast(having=[[{"select": []}]]), "medium"),
]


def test_difficulty(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLASSES)], "i int, a string")
    got = {r["i"]: r["d"] for r in df.select("i", X.difficulty(F.col("a")).alias("d")).collect()}
    assert [got[i] for i in range(len(CLASSES))] == [c for _, c in CLASSES]


def test_sample_is_balanced_and_repeatable(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") % 50 == 0, "rare").otherwise("hot"))
    one = sorted(r["id"] for r in X.stratified_sample(df, "s", 40, "id").collect())
    two = sorted(r["id"] for r in X.stratified_sample(df.repartition(13), "s", 40, "id").collect())
    assert one == two and len(one) == 80
    other = sorted(r["id"] for r in X.stratified_sample(df, "s", 40, "id", seed=7).collect())
    assert other != one
    with pytest.raises(Exception, match="not enough rows"):
        X.stratified_sample(df, "s", 101, "id").collect()
    assert X.stratified_sample(df, "s", 101, "id", strict=False).count() == 201
    ids = X.shuffled_ids(X.stratified_sample(df, "s", 40, "id"), "id", name="n").collect()
    assert sorted(r["n"] for r in ids) == list(range(80)) and [r["id"] for r in ids] != sorted(r["id"] for r in ids)


def test_first_per_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2900, 1).otherwise(2))
    got = first_per_group(df, ["g"], [F.col("id").desc()], 3, ["id"]).collect()
    assert sorted((r["g"], r["id"], r["rank"]) for r in got) == [(1, 2897, 3), (1, 2898, 2), (1, 2899, 1), (2, 2997, 3), (2, 2998, 2), (2, 2999, 1)]


@pytest.mark.parametrize("values", [
    [float(i * i % 977) for i in range(900)], [5.0] * 700 + [1.0, 9.0], [1e300, -1e300, 0.0] * 50, [0.1 + i * 1e-17 for i in range(300)], [3.0],
    [random.Random(1).lognormvariate(0, 6) for _ in range(1000)]], ids=["spread", "hot value", "extremes", "too close", "single", "skewed"])
def test_percentiles_against_sorting(spark, values):
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in values] + [("a", None)], "g string, v double")
    marks = {"low": 0.1, "median": 0.5, "p95": 0.95, "top": 1.0}
    # small limits force the rounds of narrowing
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", marks, bins=8, gather=10).collect()}
    ordered = sorted(values)
    for name, p in marks.items():
        at = (len(ordered) - 1) * p
        low = int(at)
        high = min(low + 1, len(ordered) - 1)
        want = ordered[low] + (ordered[high] - ordered[low]) * (at - low)
        assert got["a"][name] == pytest.approx(want, rel=1e-12) and got["b"][name] == got["a"][name]
    assert exact_percentiles(df, [], "v", {"median": 0.5}).head()["median"] == pytest.approx(statistics.median(values))


@pytest.mark.parametrize("shape", ["random", "all on the frontier", "one cost", "ties"])
def test_pareto_against_brute_force(spark, shape):
    rng = random.Random(3)
    points = {"random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(400)], "all on the frontier": [(i, i) for i in range(400)],
              "one cost": [(5, i % 7) for i in range(60)], "ties": [(i // 3, i // 6) for i in range(90)]}[shape]
    df = spark.createDataFrame(points, "cost int, gain int")
    best = [p for p in points if not any((q[0] <= p[0] and q[1] > p[1]) or (q[0] < p[0] and q[1] >= p[1]) for q in points)]
    assert sorted(tuple(r) for r in pareto(df, "cost", "gain", bins=16).collect()) == sorted(best)


def test_answers(spark):
    cases = {"```sql\nSELECT 1\n```": "SELECT 1", "```SELECT 1```": "SELECT 1", "  SELECT 1 \n": "SELECT 1", "SELECT '```' AS x": "SELECT '```' AS x",
             " ```sqlSELECT 1": "SELECT 1", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", X.extract_sql(F.col("a")).alias("s"))
    assert {r["a"]: r["s"] for r in df.collect()} == cases


def test_resume_and_failures(spark):
    shape = "provider string, question_id int, match boolean, error string, predicted_sql string"
    done = spark.createDataFrame([("p", 1, True, None, "a")], shape)
    new = spark.createDataFrame([("p", 1, False, None, "b"), ("p", 2, True, "down", "c")], shape)
    other = spark.createDataFrame([("p", 1, False, None, "x"), ("q", 1, False, None, "y")], shape)
    assert sorted((r["provider"], r["predicted_sql"]) for r in X.merge_results(done, other).collect()) == [("p", "a"), ("q", "y")]
    merged = {r["question_id"]: r for r in X.merge_results(done, X.failure_rows(new)).collect()}
    assert merged[1]["match"] and merged[1]["predicted_sql"] == "a"
    assert merged[2]["match"] is False and merged[2]["predicted_sql"] == "" and merged[2]["error"] == "LLM error: down"
    assert [r["question_id"] for r in X.pending(new, done).collect()] == [2]


def test_prompts(spark):
    q = spark.createDataFrame([(1, "d", "How many?"), (2, "gone", "?")], "id int, db_id string, question string")
    s = spark.createDataFrame([("d", "Table: t")], "db_id string, schema_text string")
    row, = X.build_prompts(q, s).collect()
    assert row["prompt"].startswith("Given the following database schema:\n\nTable: t\n\nWrite a SQL query to answer this question: How many?\n\nReturn only")
    assert [r["id"] for r in X.without_schema(q, s).collect()] == [2] and [r["id"] for r in X.with_schema(q, s).collect()] == [1]


def test_attribution(spark):
    shape = "question_id int, match boolean, error string"
    full = spark.createDataFrame([(1, True, None), (2, False, "x"), (3, False, "x"), (4, False, None), (5, False, "cannot JOIN")], shape)
    small = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, "y"), (4, False, None), (5, False, None)], shape)
    assert {r["question_id"]: r["cause"] for r in X.attribute_errors(full, small).collect()} == {
        1: "none", 2: "column selection", 3: "syntax", 4: "logic", 5: "missing join"}


def test_leaderboard_and_interval(spark):
    res = spark.createDataFrame([("a", True, None), ("a", False, "e"), ("b", True, None)], "provider string, match boolean, error string")
    assert [tuple(r) for r in X.leaderboard(res).collect()] == [("b", 1, 1, 0, 1.0), ("a", 2, 1, 1, 0.5)]
    a = X.accuracy_by(res, ["provider"]).filter("provider = 'a'").head()
    assert a["low"] == pytest.approx(0.0945, abs=1e-3) and a["high"] == pytest.approx(0.9055, abs=1e-3)


def test_one_infinity_does_not_stop_the_other_groups(spark):
    rows = [(g, float(i)) for g in "abc" for i in range(200)] + [("a", float("inf")), ("b", float("-inf")), ("c", float("nan"))] + [("d", float("inf"))] * 3
    got = {r["g"]: (r["low"], r["median"], r["top"]) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.0, "median": 0.5, "top": 1.0}, bins=8, gather=4).collect()}
    inf = float("inf")
    assert got["a"] == (0.0, 100.0, inf) and got["b"] == (-inf, 99.0, 199.0) and got["d"] == (inf, inf, inf)
    assert got["c"][:2] == (0.0, 100.0) and got["c"][2] != got["c"][2]


def test_mean_latency_keeps_all_decimals(spark):
    df = spark.createDataFrame([("p", v) for v in (0.004, 0.003, 1.004)], "provider string, latency_ms double")
    assert X.latency_stats(df).head()["mean"] == pytest.approx(0.337)


def test_text_that_is_no_json_has_no_class(spark):
    df = spark.createDataFrame([("not json",), ("{}",), (None,)], "a string")
    assert [r[0] for r in df.select(X.difficulty(F.col("a"))).collect()] == [None, "easy", None]


def test_latency_modes(spark, sf):
    res = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("provider"), F.col("value").alias("latency_ms"))
    exact = {r["provider"]: r for r in X.latency_stats(res).collect()}
    for r in X.latency_stats(res, approximate=True).collect():
        assert r["p95"] == pytest.approx(exact[r["provider"]]["p95"], rel=0.2)


def test_files(spark, tmp_path):
    a, b, e = (tmp_path / n for n in ("a.json", "b.json", "e.json"))
    a.write_text(json.dumps([{"db_id": "d", "question": "q", "query": "SELECT 1", "sql": {"from": {"table_units": []}, "union": None}}]))
    b.write_text(json.dumps([{"db_id": "e", "question": "r", "query": "SELECT 2"}]))
    rows = R.load_questions(spark, {"first": str(a), "second": str(b)}).orderBy("db_id").collect()
    assert [(r["db_id"], r["source"]) for r in rows] == [("d", "first"), ("e", "second")]
    assert json.loads(rows[0]["sql"])["from"] == {"table_units": []}
    e.write_text(json.dumps({"metadata": {"n": 2}, "questions": [{"id": 1, "db_id": "d"}, {"id": 2, "db_id": "e"}]}, indent=1))
    got = R.read_envelope(spark, str(e), "questions", "id: int, db_id: string")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "d"), (2, "e")]


def test_verdicts(spark):
    tests = spark.createDataFrame([("a", "s", "count", True, "OK"), ("b", "s", "count", True, "OK"), ("b", "t", "count", False, "x" * 300)],
                                  "db_id string, source string, query_type string, passed boolean, output string")
    dbs = spark.createDataFrame([("a",), ("b",), ("c",)], "db_id string")
    verdict = V.verdicts(tests, dbs)
    got = {r["db_id"]: (r["status"], len(r["reason"])) for r in verdict.collect()}
    assert got == {"a": ("PASS", 0), "b": ("FAIL", 300), "c": ("SKIP", 8)}
    assert tuple(V.validation_summary(verdict).head()) == (1, 1, 1)
    assert [len(r["error"]) for r in V.first_errors(tests, width=200).collect()] == [200]
    assert [r["error"] for r in V.first_errors(tests, n=1).collect()] == [r["error"] for r in V.first_errors(tests).collect()][:1]


def test_smoke_test_survives_a_bad_source(spark):
    good = Source.of("good", spark.range(3)).extend(measures=[row_count()])
    bad = Source.sql(spark, "bad", "SELECT * FROM there_is_no_such_table").extend(measures=[row_count()])
    got = {r["source"]: r["passed"] for r in V.smoke_test(spark, Model.build(good, bad), "d").collect()}
    assert got == {"good": True, "bad": False}


def test_audits_with_nulls(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (7,)], "k int")
    right = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "r int")
    on = [("k", "r")]
    assert V.audit_key(left, ["k"]).head().asDict() == dict(n_rows=5, n_keys=3, duplicate_keys=1, max_per_key=2, null_rows=1, is_key=False)
    assert V.audit_fk(left, right, on).head().asDict() == dict(n_rows=5, null_rows=1, orphan_rows=1, matched_rows=3, match_rate=0.6, unreferenced_keys=1)
    assert V.audit_cardinality(left, right, on).head().asDict() == dict(max_matches=2, multi_rows=1, joined_rows=6, is_one=False)
    assert left.join(right, left.k == right.r, "left").count() == 6
    empty = V.audit_key(left.limit(0), ["k"]).head()
    assert empty["n_rows"] == 0 and empty["is_key"]


def test_coverage(spark):
    cols = spark.createDataFrame([("d", "T", "A"), ("d", "T", "B"), ("d", "T", "C"), ("e", "U", "X")], "db_id string, table_name string, column_name string")
    used = spark.createDataFrame([("d", "t", "a")], "db_id string, table_name string, column_name string")
    got = {r["db_id"]: (r["full_columns"], r["minimal_columns"], r["unused_columns"]) for r in C.column_coverage(cols, used).collect()}
    assert got == {"d": (3, 1, ["t.b", "t.c"]), "e": (1, 0, ["u.x"])}
    counts = spark.createDataFrame([("a", 2, 0, 9, 1), ("b", 5, 3, 4, 0), ("c", 16, 0, 0, 0), ("d", 15, 0, 0, 0)],
                                   "db_id string, sources bigint, dimensions bigint, measures bigint, joins bigint")
    over = C.model_overview(counts).head()
    assert (over["databases"], over["total_sources"], over["avg_sources_per_db"], over["avg_measures_per_db"]) == (4, 38, 9.5, 3.3)
    assert sorted(tuple(r) for r in C.complexity_distribution(counts).collect()) == [
        ("complex (8-15 tables)", 1), ("medium (4-7 tables)", 1), ("simple (1-3 tables)", 1), ("very complex (16+ tables)", 1)]


def test_stream_equals_batch(spark, sf, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("question_id"), F.col("event_type").alias("provider"), (F.col("event_id") % 3 == 0).alias("match"),
        F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("event_time"))
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(S.RESULT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    state = S.run_available(spark, S.stream_metrics(stream))
    batch = rows.groupBy(F.window("event_time", "1 day")["start"].alias("w"), "provider").agg(F.count("*").alias("n"))
    assert sorted((r["window_start"], r["provider"], r["total"]) for r in state.collect()) == sorted(tuple(r) for r in batch.collect())


def test_results_of_one_provider_leave_those_of_another_open(spark):
    asked = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "provider string, question_id int")
    done = spark.createDataFrame([("p", 1), ("q", 2)], "provider string, question_id int")
    assert [tuple(r) for r in X.pending(asked, done).collect()] == [("q", 1)]
    assert X.pending(asked.select("question_id").distinct(), done).count() == 0
    assert X.pending(asked, done, "question_id").count() == 0


def _arrivals(spark, path, files):
    """One file per list of (question, day), in the order they are read."""
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(q, "p", True, None, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for q, d in rows], S.RESULT_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times


def test_stream_state_does_not_pile_up_and_late_rows_are_counted(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    _arrivals(spark, path, [[(1, 0), (2, 0)], [(3, 100)], [(4, 101), (11, 100)], [(5, 1), (6, 2), (7, 101)]])
    stream = lambda: S.stream_metrics(spark.readStream.schema(S.RESULT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    state, late = S.run_counted(spark, stream(), folder)
    days = lambda df: {r["window_start"].timetuple().tm_yday - 1: r["total"] for r in df.collect()}
    assert sum(r["late"] for r in late.collect()) == 2
    assert days(state) == {0: 2, 100: 2, 101: 2}
    assert len(S.generations(spark, f"{folder}/updates")) == 2
    # A later run goes on from the state; what is read stays one generation.
    _arrivals(spark, path, [[(8, 101)], [(9, 102), (10, 3)]])
    state, late = S.run_counted(spark, stream(), folder)
    assert days(state) == {0: 2, 100: 2, 101: 3, 102: 1} and sum(r["late"] for r in late.collect()) == 1
    done = S.generations(spark, f"{folder}/updates")
    assert len(done) == 2 and {f.split("/")[-2] for f in state.inputFiles()} == {f"state-{done[-1]}"}


def test_state_that_was_not_written_whole_is_not_read(spark, tmp_path):
    base = str(tmp_path)
    assert S.generations(spark, f"{base}/none") == [] and S.latest(spark, f"{base}/none").count() == 0
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), None, 3, 2, 1)], S.STATE_SCHEMA)
    one.write.parquet(f"{base}/state-9")
    one.unionByName(one).write.parquet(f"{base}/state-10")
    os.remove(f"{base}/state-10/_SUCCESS")
    assert S.generations(spark, base) == [9] and S.latest(spark, base).count() == 1


def test_percentiles_shuffle_bins_and_not_values(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).cast("bigint").alias("n"))
    wanted = spark.createDataFrame([(g, 0.0, 19_999.0) for g in range(3)], "g bigint, lo double, hi double")
    histogram = selection._histogram(df, wanted, ["g"], 64)
    plan = histogram._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert exchanges and all("bin#" in line and " v#" not in line and "(v#" not in line for line in exchanges)
    rows = histogram.collect()
    assert len(rows) == 3 * 64 and sum(r["count"] for r in rows) == 20_000


def test_percentiles_of_many_groups_and_of_null(spark, monkeypatch):
    rows = [(None if g == 0 else g, float(i * i % 97)) for g in range(6) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, v double")
    want = statistics.median(float(i * i % 97) for i in range(50))
    for limit in (200_000, 1):
        monkeypatch.setattr(selection, "sized", lambda x, limit=limit: sized(x, limit))
        got = {r["g"]: r["median"] for r in exact_percentiles(df, ["g"], "v", {"median": 0.5}, bins=8, gather=5).collect()}
        assert got == {g: want for g in (None, 1, 2, 3, 4, 5)}
        assert exact_percentiles(df, [], "v", {"median": 0.5}, bins=8, gather=5).head()["median"] == want
    none = df.filter("g > 99")
    assert exact_percentiles(none, ["g"], "v", {"median": 0.5}).count() == 0 and exact_percentiles(none, [], "v", {"median": 0.5}).head()["median"] is None
    stats = {r["lang"]: r["median"] for r in P.token_stats(df.withColumnsRenamed({"g": "lang"}), ["lang"], "v").collect()}
    assert stats[None] == want and len(stats) == 6
