import inspect

import corpus_pipeline
from conftest import WORD, make
from semaspark.llm.frames import stage
from semaspark.llm.registry import ORACLES, QUERIES


def test_stages_chain(spark, sf, documents):
    docs, columns = documents, documents.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(step).parameters) == ["spark", "docs", "sf_dir"]
        docs = stage(step(spark, docs, sf), name)
        assert docs.columns == columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(i for i, _ in texts)
    assert all(WORD.search(t) for _, t in texts)


def test_run_and_odd_tables(spark, sf, odd, empty):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for docs in (odd, empty, make(spark, [(1, None, None, None)])):
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, sf), name)
        assert docs.count() >= 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
