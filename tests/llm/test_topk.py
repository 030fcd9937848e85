import numpy as np
import pytest
from pyspark.sql import functions as F

from semaspark.llm import topk


def brute(rows, k, divisor):
    kept = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * x)) for x in v]
        kept[i] = min(kept.get(i, w), w)
    out = []
    for q in kept:
        if q % divisor == 0:
            best = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,block,leaf", [(8192, 2048, 128), (64, 4, 8)])
def test_like_brute_force(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk.leaf_order, "__defaults__", (leaf,))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    same = rng.normal(size=6).tolist()
    rows += [(i, same) for i in range(300, 400)] + [(400, [1e6] * 6), (401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6)]
    rows += [(None, same), (405, [1.0, 2.0]), (406, [3.0, 4.0]), (10, rows[10][1]), (408, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    got = sorted(tuple(r)[:4] for r in topk.top_k(df, F.col("vec_id") % 3 == 0).collect())
    assert got == brute(rows, 5, 3)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-200, 200, size=(1000, 8)).astype(float)
    order, ends = topk.leaf_order(vectors, 50)
    assert sorted(order.tolist()) == list(range(1000)) and ends[-1] == 1000 and max(np.diff([0, *ends])) <= 50
