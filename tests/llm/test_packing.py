import random
import tracemalloc
import zlib

import numpy as np
import pytest

from conftest import make
from semaspark.llm import packing


def encoded(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, packing.END_ID], "<u4")


def check(rows, texts, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = sorted((i, p, p * capacity, len(x), zlib.crc32(x.tobytes())) for i, t in texts for ids in [encoded(t)] for p in range(-(-len(ids) // capacity)) for x in [ids[p * capacity : (p + 1) * capacity]])
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(bins)


@pytest.mark.parametrize("group", [32768, 16])
def test_round_trip_and_bound(documents, group):
    rows = packing.pack_documents(documents, capacity=512, group=group).collect()
    bins = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], 512)
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 512)
    assert bound <= bins <= bound * 1.02 + 1


def test_tricky_texts(spark, odd, empty):
    texts = ["it's They'RE x's. a.b,c d;e!! 's", "<|endoftext|> text|> <|startoftext|>a", "É́ ﬁ   é. İstanbul ǅ 中文，字", "a" * 3000, "x%%% y&&&z $5.00 #1", "  ﻿ . \x00 \x1c", "I'll'd don't' 'tis ''s"]
    rng = random.Random(4)
    texts += ["".join(rng.choice("aé.'s t|<>!1 \n#") for _ in range(80)) for _ in range(200)]
    docs = make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    check(packing.pack_documents(docs).collect(), list(enumerate(texts)), 4096)
    got = packing.pack_documents(odd.where("doc_id is not null")).collect()
    check(got, [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()], 4096)
    assert packing.pack_documents(odd).count() == len(got) + 1 and packing.pack_documents(empty).count() == 0


def test_bound_and_best_fit():
    sizes = np.array([60, 60, 60, 40, 40, 40])
    bins, offset, fill = packing.best_fit_decreasing(sizes, 100)
    assert fill.tolist() == [100, 100, 100] and packing.lower_bound(sizes, 100) == 3
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3 and packing.lower_bound(np.array([34] * 6), 100) == 3
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 101, 200)
        assert packing.lower_bound(sizes, 100) <= len(packing.best_fit_decreasing(sizes, 100)[2])


def test_memory_does_not_follow_the_batch():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)]
    encoder = packing.Encoder(packing.vocabulary())
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(2000)]
    whole = [ids.tolist() for part, ids, _ in packing.encoded(encoder, packing.pa.array(texts[:50]))]
    encoder.forget()
    tracemalloc.start()
    first = next(packing.encoded(encoder, packing.pa.array(texts)))
    for _ in packing.encoded(encoder, packing.pa.array(texts)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and first[1][: len(whole[0])].tolist() == whole[0]
