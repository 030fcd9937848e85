"""Texts over databases of their own: name spaces, time limits, equal texts, answers in one folder."""

import time

import pytest
from pyspark.sql import functions as F

from semaspark.operators import answers as A

PAIRS = "question_id int, db_id string, predicted string, gold string"
ENDLESS = "SELECT COUNT(*) FROM range(10000000000000) r JOIN t ON r.id % 7 = x"


@pytest.fixture(scope="module")
def locations(spark, tmp_path_factory):
    root, rows = tmp_path_factory.mktemp("databases"), []
    for db, values in (("one", [1, 2, 3]), ("two", [1, 2, 3, 4]), ("none", [])):
        path = str(root / db)
        spark.createDataFrame([(v, f"{db}{v}") for v in values], "x int, name string").write.parquet(path)
        rows.append((db, "t", path))
    return spark.createDataFrame(rows, "db_id string, table_name string, path string")


def verdicts(spark, locations, pairs, **more):
    out = A.compare_databases(spark, spark.createDataFrame(pairs, PAIRS), A.located(spark, locations), **more)
    return {r["question_id"]: (r["match"], r["error"]) for r in out.collect()}


def test_one_table_name_in_two_databases(spark, locations):
    texts = ("SELECT COUNT(*) FROM t", "SELECT 3 + COUNT(*) - COUNT(x) FROM t")
    got = verdicts(spark, locations, [(1, "one", *texts), (2, "two", *texts), (3, "one", "SELECT x FROM t", "SELECT x FROM t WHERE x < 9"), (4, "none", "SELECT * FROM t", "SELECT x FROM t"),
                                      (5, "two", "SELECT x, name FROM t ORDER BY x", "SELECT name, x FROM t ORDER BY x"), (6, "two", "SELECT x FROM t ORDER BY x DESC", "SELECT x FROM t ORDER BY x"),
                                      (7, "absent", "SELECT * FROM t", "SELECT 1")])
    assert {k: m for k, (m, _) in got.items()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False}
    assert got[7][1].startswith("Predicted SQL error") and "t" in got[7][1]


def test_a_text_is_cut_after_its_limit_and_others_are_not(spark, locations):
    began = time.monotonic()
    got = verdicts(spark, locations, [(1, "one", ENDLESS, "SELECT 1"), (2, "one", "SELECT x FROM t", "SELECT x AS y FROM t"), (3, "two", "SELECT 1", ENDLESS)], limit=4, workers=3)
    assert got[1] == (False, "Predicted SQL error: Query timed out") and got[2] == (True, None) and got[3] == (False, "Gold SQL error: Query timed out")
    assert time.monotonic() - began < 120
    assert spark.range(5).count() == 5 and len(spark.sparkContext.getJobTags()) == 0


def test_equal_texts_run_once_into_one_folder(spark, locations):
    texts = spark.createDataFrame([("one", "SELECT x FROM t")] * 5 + [("two", "SELECT x FROM t"), ("one", "SELEC")], "db_id string, sql string")
    answers = A.run_texts(spark, texts, A.located(spark, locations))
    assert sorted((r["n_rows"] or -1, r["n_cols"]) for r in answers.headers.collect()) == [(-1, 0), (3, 1), (4, 1)]
    assert answers.rows.count() == 7 and "Union" not in answers.rows._jdf.queryExecution().toString()
    by = answers.rows.groupBy("answer").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert all(r["p"] == list(range(len(r["p"]))) for r in by)


def test_order_of_answers_with_many_tasks(spark, locations):
    wide = "SELECT id FROM range(0, 5000, 1, 7) ORDER BY id"
    got = verdicts(spark, locations, [(1, "one", wide, wide + " "), (2, "one", wide + " DESC", wide), (3, "one", "SELECT id FROM range(0, 5000, 1, 3) ORDER BY id", wide)])
    assert [got[i][0] for i in (1, 2, 3)] == [True, False, True]


def test_run_keeps_earlier_results_and_counts_failures(spark, locations):
    questions = spark.createDataFrame([(1, "one", "a", "SELECT COUNT(*) FROM t"), (2, "two", "b", "SELECT COUNT(*) FROM t"), (3, "gone", "c", "SELECT 1")], "question_id int, db_id string, question string, gold_sql string")
    replies = spark.createDataFrame([("p", 1, "```sql\nSELECT 3\n```", None, 1.0), ("p", 2, None, "busy", 2.0), ("q", 1, "SELECT 4", None, 3.0), ("q", 2, "SELECT 4", None, 4.0), ("q", 3, "SELECT 1", None, 5.0)],
                                    "provider string, question_id int, reply string, error string, latency_ms double")
    done = spark.createDataFrame([("q", 1, "one", "a", "x", "y", True, None, 9.0)], "provider string, question_id int, db_id string, question string, gold_sql string, predicted_sql string, match boolean, error string, latency_ms double")
    out = A.run_evaluation(spark, questions, replies, locations.select("db_id"), A.located(spark, locations), done)
    got = {(r["provider"], r["question_id"]): (r["match"], r["error"], r["predicted_sql"]) for r in out.collect()}
    assert got == {("p", 1): (True, None, "SELECT 3"), ("p", 2): (False, "LLM error: busy", ""), ("q", 1): (True, None, "y"), ("q", 2): (True, None, "SELECT 4")}


def test_no_pairs(spark, locations):
    assert verdicts(spark, locations, []) == {}


def test_texts_that_only_waited_for_a_slow_one_are_not_cut(spark, locations):
    # The endless text has a task on every core, so the others get none until it is cut, when their own time is over too.
    pairs = [(0, "one", ENDLESS, "SELECT 1")] + [(i, "one", f"SELECT COUNT(*) + {i} FROM range(0, 1000, 1, 16)", f"SELECT 1000 + {i} FROM range(0, 1, 1, 16)") for i in range(1, 4)]
    got = verdicts(spark, locations, pairs, limit=5, workers=8)
    assert got == {0: (False, "Predicted SQL error: Query timed out"), 1: (True, None), 2: (True, None), 3: (True, None)}
