from pyspark.sql import functions as F

from checks.derived import log_catalog, raw_catalogs
from semaspark.sources.catalog import Catalog


def test_databases_are_spread_over_tasks(spark, tmp_path):
    """Narrow tables are one small file; what is made of their rows must not stay in the one task that reads it."""
    spark.range(400).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).select(F.col("id").alias("s_suppkey"), F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for df, n in ((raw_catalogs(spark, str(tmp_path)), 400), (log_catalog(spark, str(tmp_path)).tables, 3200)):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert df.count() == n


def test_name_is_computed_once_in_a_filter(spark):
    from semaspark.operators.derive import derive_dimensions

    columns = spark.createDataFrame([("d", "t", "Year")], "db_id string, table_name string, column_name string")
    plan = derive_dimensions(columns)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.split("\n") if "Filter" in line)
    assert condition.count("translate(") == 1


def test_rows_are_dealt_over_more_tasks_where_there_are_more(spark):
    from checks.compare_checks import _dealt

    assert [_dealt(spark.range(0, 100, 1, n)).rdd.getNumPartitions() for n in (1, 20)] == [5, 40]


def test_tokens_of_a_text_are_read_once(spark):
    from semaspark.operators.workload import distinct_queries, joins_used

    log = spark.createDataFrame([("db_1", "SELECT 1 FROM a x JOIN b y ON x.k = y.k")], "db_id string, query string")
    tables = spark.createDataFrame([("db_1", 0, "a"), ("db_1", 1, "b")], "db_id string, table_idx int, table_name string")
    found = joins_used(distinct_queries(log), Catalog(tables, tables, tables, tables), resolve_aliases=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(transform(") == 1
    assert [tuple(r) for r in found.collect()] == [("db_1", "a", "k", "b", "k")]


def test_pairs_of_columns_unfold_numbers(spark):
    from semaspark.operators.batch_compare import _pair_prints

    data = [(1, side, None, vals) for side in ("gold", "pred") for vals in (["a", "b", "a"], ["c", "c", "c"])] + [(2, "gold", None, ["a"])]
    rows = spark.createDataFrame(data, "question_id int, side string, pos bigint, vals array<string>")
    prints = _pair_prints(rows)
    assert "flatten" not in prints._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["question_id"], r["side"], r["i"], r["j"]): (r["same"], tuple(r["fp"])) for r in prints.collect()}
    assert set(found) == {(1, side, i, j) for side in ("gold", "pred") for i in range(3) for j in range(3) if i != j}
    assert {(i, j): same for (_, side, i, j), (same, _) in found.items() if side == "gold"} == {
        (0, 1): False, (1, 0): False, (0, 2): True, (2, 0): True, (1, 2): False, (2, 1): False}
    assert found[1, "gold", 0, 1] == found[1, "pred", 0, 1] == found[1, "gold", 2, 1] != found[1, "gold", 1, 0]


def unfolded(spark, path):
    """A catalog that is a small file before it is unfolded; that is the size Spark would go by."""
    from semaspark.sources.catalog import RAW_SCHEMA, load_catalog, raw_catalog

    raw = [(f"db_{i}", ["a", "b"], [["-1", "*"], ["0", "Id"], ["1", "Id"], ["1", "a_id"]], ["text", "number", "number", "number"], [1, 2], [[3, 1]]) for i in range(3)]
    spark.createDataFrame(raw, RAW_SCHEMA).write.parquet(path)
    return load_catalog(raw_catalog(spark.read.parquet(path)))


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_names_of_a_log_are_not_broadcast(spark, tmp_path):
    from semaspark.operators.workload import derive_minimal

    log = spark.createDataFrame([("db_1", "SELECT max(a_id) FROM b")], "db_id string, query string")
    _, dims, measures = derive_minimal(log, unfolded(spark, f"{tmp_path}/catalog"))
    assert not broadcasts(dims) and not broadcasts(measures)
    assert [tuple(r) for r in dims.collect()] == [("db_1", "b", "a_id", "a_id")]
    assert sorted(r["measure"] for r in measures.collect()) == ["max_a_id", "row_count"]


def test_unfolded_models_are_not_broadcast(spark, tmp_path):
    from semaspark.operators.derive import derive_model

    full = derive_model(unfolded(spark, f"{tmp_path}/catalog"))
    assert not broadcasts(full.sources) and not broadcasts(full.joins)
    assert sorted(r[:3] for r in full.sources.select("db_id", "source", "level").collect()) == [(f"db_{i}", t, n) for i in range(3) for t, n in (("a", 0), ("b", 1))]


def compared(spark):
    """Four questions of two columns alike and one that tells them apart; 1 is turned round as a whole, 2 in part, 3 not at all, 4 is ordered."""
    from semaspark.operators import batch_compare as B

    def one(q, side, turned):
        pairs = [(str(2 * i), str(2 * i + 1)) for i in range(6)]
        rows = [(b, a, z) if turned(i) else (a, b, z) for i, (x, y) in enumerate(pairs) for a, b, z in ((x, y, "0"), (y, x, "1"))]
        return [(q, side, n, list(v)) for n, v in enumerate(rows)]

    never, always, some = (lambda i: False), (lambda i: True), (lambda i: i == 2)
    data = [r for q, t in ((1, always), (2, some), (3, never), (4, always)) for r in one(q, "gold", never) + one(q, "pred", t)]
    rows = spark.createDataFrame(data, "question_id bigint, side string, pos bigint, vals array<string>")
    heads = spark.createDataFrame([(q, side, 12, 3, None, q == 4) for q in range(1, 5) for side in ("gold", "pred")],
                                  "question_id bigint, side string, n_rows bigint, n_cols int, error string, ordered boolean")
    return {r["question_id"]: r["match"] for r in B.compare_rows(heads, rows).collect()}


def test_rows_are_staged_once_and_not_dealt(spark, monkeypatch):
    from semaspark.operators import batch_compare as B

    wide, staged = [], []
    cut, stage = B.cut_lineage, B.stage_rows
    monkeypatch.setattr(B, "cut_lineage", lambda df: (wide.append("vals" in df.columns), cut(df))[1])
    monkeypatch.setattr(B, "stage_rows", lambda df, label: (staged.append(label), stage(df, label))[1])
    want = {1: True, 2: False, 3: True, 4: True}
    assert compared(spark) == want and not any(wide) and staged == ["answers"]
    for most, pieces in ((2, 3), (2, 1)):  # the lists are sent in pieces; they are dealt with the rows
        monkeypatch.setattr(B, "BROADCAST_ROWS", most)
        monkeypatch.setattr(B, "PIECES", pieces)
        assert compared(spark) == want
