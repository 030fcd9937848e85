import math

from conftest import make
from semaspark.llm import mixing


def test_targets_and_words_taken(spark, documents):
    rows = [r.asDict() for r in mixing.plan(documents).collect()]
    assert rows == rows and len(rows) == documents.count()
    by = {}
    for r in rows:
        by.setdefault(r["source_size"] and r["target"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    total = sum(r["size"] for r in rows)
    targets = {}
    text = {r["doc_id"]: r["source"] for r in documents.collect()}
    for r in rows:
        s = targets.setdefault(text[r["doc_id"]], [r["target"], r["source_size"], 0, 0])
        s[2] += r["taken"]
        s[3] = max(s[3], r["size"])
    assert math.isclose(sum(t[0] for t in targets.values()), 1.5 * total, rel_tol=1e-9)
    for target, size, taken, largest in targets.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= largest / 2 + 1


def test_same_again_in_any_partitioning(documents):
    first = sorted(map(tuple, mixing.plan(documents).collect()))
    assert sorted(map(tuple, mixing.plan(documents.repartition(7)).collect())) == first


def test_odd_rows(odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sorted(r["doc_id"] for r in mixed.collect() if r["doc_id"] in (1, 2, 3)) == [1, 2, 3]


def test_mix_repeats_what_plan_takes(documents):
    taken = {r["doc_id"]: r["taken"] for r in mixing.plan(documents).collect()}
    size = {r["doc_id"]: r["size"] for r in mixing.plan(documents).collect()}
    seen = {}
    for r in mixing.mix(documents).select("doc_id").collect():
        seen[r[0]] = seen.get(r[0], 0) + 1
    assert all(seen.get(i, 0) * size[i] == taken[i] for i in size if size[i])


def test_one_source_only(spark):
    rows = mixing.plan(make(spark, [(i, "w " * (i + 1), "en", "s") for i in range(20)])).collect()
    assert rows[0]["target"] == 315.0 and abs(sum(r["taken"] for r in rows) - 315) <= 10
