import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import WORD
from semaspark.llm import maxent
from semaspark.llm.words import chunks

LOW = {c: c + 32 for c in range(65, 91)}


def token_list(text):
    return [w.translate(LOW) for w in WORD.findall(text or "")] + [None]


def test_counts_and_base_score(documents, odd):
    for docs in (documents.select("doc_id", "text"), odd):
        train = docs.where(~maxent.held_out())
        counts = Counter(t for r in train.collect() for t in token_list(r["text"]))
        n, v = sum(counts.values()), len(counts)
        model, table, got_n, got_v = maxent.fit(train)
        assert (got_n, got_v) == (n, v)
        want = sorted((len(t), sum(counts[x] > 0 for x in t), round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for r in docs.collect() for t in [token_list(r["text"])])
        for head in (maxent.HEAD, 50):  # the rare tokens by join give the same
            got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in maxent.score(docs, model, table, n, v, head=head).collect())
            assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_held_out_is_the_id_as_text(documents):
    for r in documents.select("doc_id", maxent.held_out().alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_model_beats_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, counts, n, v = maxent.fit(docs.where(~maxent.held_out()))
    r = maxent.score(docs.where(maxent.held_out()), model, counts, n, v).selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_softmaxes_sum_to_one():
    rng = np.random.default_rng(0)
    model = maxent.initial(rng.integers(0, 50, 1024).astype(float), rng.integers(0, 9, 1024).astype(float))
    model.classes += rng.normal(size=model.classes.shape).astype(np.float32)
    t = maxent.tokens(next(chunks(pa.array(["a b c. D e", "", "f"]))))
    assert t.row.tolist() == [0] * 6 + [1] + [2] * 2 and t.place.tolist() == [0, 1, 2, 3, 4, 5, 0, 0, 1]
    by_class, by_slot = maxent.context(t)
    for w, rows in ((model.classes, by_class), (model.slots, by_slot)):
        assert np.allclose(np.exp(maxent.log_softmax(w, rows)).sum(1), 1, atol=1e-4)


def test_no_rows(empty):
    model, counts, n, v = maxent.fit(empty)
    assert (n, v) == (0, 0) and maxent.score(empty, model, counts, n, v).count() == 0
