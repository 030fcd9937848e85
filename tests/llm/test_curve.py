import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make
from semaspark.llm import curve

AXES = (curve.Axis("lang", "values"), curve.Axis("source", "values"), curve.Axis("n_chars", "octaves"), curve.Axis("doc_id", "linear"))


def test_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = con.execute(curve.OP12_SQL)
    names = [c[0] for c in r.description]
    got = curve.op12_hilbert(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(r.fetchall())


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_once_in_unit_steps(axes, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    index = curve.hilbert(list(points.T), bits)
    assert sorted(index) == list(range(len(points)))
    path = points[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_rows_of_shards_and_slots(spark, documents):
    for n in (1, 7, 24, 500):
        rows = curve.shard(documents.drop("text"), AXES, n, ("doc_id",)).select("shard", "slot").collect()
        of = {}
        for s, slot in rows:
            of.setdefault(s, []).append(slot)
        assert len(rows) == documents.count() and set(of) <= set(range(n))
        assert all(sorted(v) == list(range(len(v))) for v in of.values())
        sizes = [len(of.get(s, [])) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1


def test_same_in_any_partitioning(documents):
    first = sorted(map(tuple, curve.shard(documents.select("doc_id", "lang", "source", "n_chars"), AXES, 24, ("doc_id",)).collect()))
    assert sorted(map(tuple, curve.shard(documents.select("doc_id", "lang", "source", "n_chars").repartition(5), AXES, 24, ("doc_id",)).collect())) == first


def test_filters_skip_more_files_than_in_order_of_id(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    curve.write_shards(documents, path, AXES, 16, ("doc_id",))
    back = spark.read.parquet(path)
    assert back.count() == documents.count()
    columns = ["lang", "source", "n_chars", "doc_id"]
    ours = {r["shard"]: r for r in curve.boxes(back, columns).collect()}
    by_id = documents.withColumn("shard", F.floor(F.col("doc_id") * 16 / (documents.agg(F.max("doc_id")).first()[0] + 1)))
    plain = {r["shard"]: r for r in curve.boxes(by_id, columns).collect()}

    def read(boxes):
        filters = [("lang", x, x) for x in ("de", "es", "fr")] + [("source", f"src{i}", f"src{i}") for i in range(20)] + [("n_chars", 0, 300)]
        return sum(b[f"min_{c}"] <= high and b[f"max_{c}"] >= low for b in boxes.values() for c, low, high in filters)

    assert read(ours) < 0.75 * read(plain)


def test_odd_rows(spark, odd, empty):
    rows = curve.shard(odd, AXES, 3, ("doc_id",)).collect()
    assert len(rows) == odd.count() and sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in rows)))
    out = curve.shard(empty, AXES, 3)
    assert out.count() == 0 and set(odd.columns) < set(out.columns)
    same = make(spark, [(None, "x", None, None)] * 50)
    counts = curve.shard(same, AXES, 8, ("doc_id",)).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [6] * 6 + [7] * 2
    with pytest.raises(ValueError, match="column slot"):
        curve.shard(odd.withColumn("slot", F.lit(1)), AXES)
    far = spark.createDataFrame([(-2**63,), (2**63 - 1,), (0,), (None,)], "doc_id long")
    cells = {r["value"]: r["cell"] for r in curve.cells(far, curve.Axis("doc_id", "linear")).collect()}
    assert cells == {None: 0, 0: 64, 2048: 128, 4095: 192}


def test_quotients_do_not_round_up(spark):
    n = 10**13 + 7
    df = spark.createDataFrame([(i * n // 24 + d,) for i in range(1, 24) for d in (0, 1)], "x long")
    got = df.select("x", curve.whole(F.col("x").cast("decimal(20,0)") * 24, F.lit(n)).alias("q")).collect()
    assert all(q == x * 24 // n for x, q in got)
