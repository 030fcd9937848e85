import time

import duckdb

from conftest import make
from semaspark.llm import linededup


def test_like_sql(spark, sf, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(linededup.OP5_SQL).fetchall()
    got = [tuple(r) for r in linededup.line_report(documents).collect()]
    assert sorted(got) == sorted(want)


def test_overlapping_windows_and_order(spark):
    rows = [(1, "a\nb\nc\nd", "en", "s"), (2, "x\n b \n\nc\nd\ny", "en", "s"), (3, "r\nr\nr\nr\nr", "en", "s"), (4, "a\nb", "en", "s"), (5, "a\nb\nc\nd", "en", "s")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.line_report(make(spark, rows)).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\n\ny", 3), 3: ("r", 4), 4: ("a\nb", 0), 5: ("", 4)}
    kept = linededup.drop_repeats(make(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]


def test_odd_rows(odd, empty):
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in linededup.line_report(odd).collect()), key=repr)
    texts = {i: (t, n) for i, t, n in got}
    assert texts[1] == (None, 0) and texts[2] == ("", 0) and texts[3] == (" \n\t ", 0) and texts[6] == ("x\ny\nz\nw", 0) and texts[7] == ("", 4)
    kept = linededup.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert linededup.line_report(empty).count() == 0 and linededup.drop_repeats(empty).count() == 0


def test_no_python_worker_and_time_in_proportion(spark):
    docs = make(spark, [(1, "a\nb\nc", "en", "s")])
    plan = linededup.drop_repeats(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    block = "\n".join(f"line {i}\n" for i in range(40_000))
    rows = [(1, block, "en", "s"), (2, "x\n" + block + "y é", "en", "s")]
    start = time.monotonic()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.line_report(make(spark, rows)).collect()}
    assert got[1] == (block, 80_000, 0)
    assert got[2] == ("x\n" + "\n" * 39_999 + "y é", 80_001, 40_000)
    assert time.monotonic() - start < 60
