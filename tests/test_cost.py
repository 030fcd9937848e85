import pytest
from pyspark.sql import functions as F

from checks.derived import PRICES, prices
from semaspark.operators import cost as P

# Millions of tokens, input and output: 1,000 questions in one step, and the three steps below together.
SINGLE = {m: 0.853 * i + 0.127 * o for m, i, o in PRICES}
THREE = {m: 1.3654 * i + 0.219 * o for m, i, o in PRICES}


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([(1, "build", 5400, 9000), (2, "answer", 1120000, 150000), (3, "correct", 240000, 60000)],
                                 "question_id int, step string, input_tokens bigint, output_tokens bigint")


def test_single_step(spark):
    usage = spark.range(1000).select(F.col("id").alias("question_id"), F.lit(853).alias("input_tokens"), F.lit(127).alias("output_tokens"))
    got = {r["model"]: r for r in P.run_cost(usage, prices(spark)).collect()}
    assert {m: float(r["total_cost"]) for m, r in got.items()} == pytest.approx(SINGLE)
    assert got["amber"]["questions"] == 1000 and got["amber"]["per_question"] == pytest.approx(SINGLE["amber"] / 1000)


def test_steps(spark, steps):
    got = {r["model"]: float(r["cost"]) for r in P.stepwise_cost(steps, prices(spark)).filter("step is null").collect()}
    assert set(got) == {m for m, *_ in PRICES}
    assert got == pytest.approx(THREE)
    less = {r["model"]: float(r["cost"]) for r in P.stepwise_cost(steps, prices(spark), {"correct": 0.5}).filter("step = 'correct'").collect()}
    assert less["cedar"] == pytest.approx((0.24 * 0.85 + 0.06 * 3.4) / 2)


def test_hybrid(spark, steps):
    rows = [("all ember", s, "ember") for s in ("build", "answer", "correct")] + [("mixed", "build", "ember"), ("mixed", "answer", "birch"), ("mixed", "correct", "ember")]
    got = {r["configuration"]: float(r["total_cost"]) for r in P.hybrid_cost(
        steps, spark.createDataFrame(rows, "configuration string, step string, model string"), prices(spark)).collect()}
    assert got["all ember"] == pytest.approx(THREE["ember"])
    assert got["mixed"] == pytest.approx((0.0054 + 0.24) * 0.075 + (0.009 + 0.06) * 0.31 + 1.12 * 2.2 + 0.15 * 9.9)


def test_budget(spark):
    # Planned cost of each experiment.
    items = [("1", x) for x in (0.41, 0.57, 0.69, 1.49, 4.46)] + [("2", x) for x in (0.67, 0.96, 1.13, 2.46, 6.19, 5.95)] + [("3", x) for x in (0.8, 0.75, 1.2, 2.88)]
    got = {r["phase"]: r["cost"] for r in P.budget(spark.createDataFrame(items, "phase string, cost double")).collect()}
    assert got == pytest.approx({"1": 7.62, "2": 17.36, "3": 5.63, "buffer": 6.12, "total": 36.73})


def test_projection(spark):
    # Cost of 1,000 questions and of 8,034.
    rows = [(0.96, 7.71), (5.95, 47.80), (7.38, 59.29)]
    got = P.project_cost(spark.createDataFrame([(c,) for c, _ in rows], "cost double"), 1000, 8034).collect()
    assert [r["projected"] for r in got] == [v for _, v in rows]


def test_discounts(spark):
    kinds = [(True, False, 0), (False, True, 1000000), (True, True, 1000000), (False, False, 1000000)]
    usage = spark.createDataFrame([(m, c, b, 1000000, out) for m in ("cedar", "ember") for c, b, out in kinds], "model string, cached boolean, batch boolean, input_tokens bigint, output_tokens bigint")
    got = {r["model"]: r for r in P.apply_discounts(usage, prices(spark), ["model"]).collect()}
    for m, i, o in (("cedar", 0.85, 3.4), ("ember", 0.075, 0.31)):
        assert float(got[m]["list_cost"]) == pytest.approx(4 * i + 3 * o, abs=1e-12)
        assert float(got[m]["paid_cost"]) == pytest.approx(0.1 * i + (i + o) / 2 + (0.1 * i + o) / 2 + i + o, abs=1e-12)


def test_buckets(spark):
    # How many schemas fall into each size.
    sizes = [50] * 34 + [100] * 101 + [499] * 23 + [500] * 8
    got = {r["bucket"]: (r["n"], round(r["percent"])) for r in P.size_buckets(spark.createDataFrame([(s,) for s in sizes], "t int"), "t").collect()}
    assert got == {"< 100": (34, 20), "100-300": (101, 61), "300-500": (23, 14), "500+": (8, 5)}


def test_early_stop(spark):
    rows = [("poor", i, i % 10 == 0) for i in range(50)] + [("good", i, True) for i in range(50)] + [("short", i, False) for i in range(5)]
    got = {r["c"]: (r["seen"], r["stop"]) for r in P.early_stop(spark.createDataFrame(rows, "c string, i int, match boolean"), ["c"], ["i"], 20, 0.3).collect()}
    assert got == {"poor": (20, True), "good": (20, False), "short": (5, False)}
