import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import make
from semaspark.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15])


@settings(max_examples=3000, deadline=None)
@given(st.text("a@.1-+ 25(09é\n", max_size=40))
def test_patterns_like_plain_matching(text):
    assert pii.base_spans(text) == brute(text)


def test_queries_like_brute_force(documents):
    got = {r["doc_id"]: r for r in pii.find(documents, pii.fit(documents)).collect()}
    for r in documents.collect():
        base = brute(r["text"])
        assert got[r["doc_id"]]["base"] == pii.said(base)
        assert set(got[r["doc_id"]]["base"].split(",")) - {""} <= set(got[r["doc_id"]]["spans"].split(","))


def test_repeated_words_share_a_label():
    field = pii.Field.blank()
    field.pairs[2] = np.eye(5) * 6
    text = "call +15551234567 now; later 15551234567 again and 99887766554 not"
    part = next(pii.chunks(pii.pa.array([text])))
    base = [pii.base_spans(text)]
    added = pii.added_spans(field, pii.nodes_of(part, base), base)
    assert [text[a:b] for _, (a, _, b) in added] == ["15551234567"] and added[0][1][1] == 3


def test_far_repeats_share_a_label():
    field = pii.Field.blank()
    field.pairs[2] = np.eye(5) * 6
    text = "call +15551234567 now" + " and then some words until 15551234567 again" * 60
    part = next(pii.chunks(pii.pa.array([text])))
    base = [pii.base_spans(text)]
    added = pii.added_spans(field, pii.nodes_of(part, base), base)
    assert len(added) == 60 and all(text[a:b] == "15551234567" and k == 3 for _, (a, k, b) in added)


def test_short_words_have_edges():
    n = pii.nodes_of(next(pii.chunks(pii.pa.array(["a1@b and 1234 x y z w then 1234 x y z w a1@b"]))), [[]])
    assert pii.edges_of(n)[2].tolist().count(3) == 4


def test_a_long_log_leaves_the_other_documents_in(spark):
    log = " ".join(f"{i % 10}.{i}" for i in range(21_000))
    first = spark.range(1000, 3000).orderBy(pii.F.xxhash64("id", pii.F.lit(log))).first()[0]
    rows = [(first, log, "en", "a")]
    rows += [(i, f"text ({200 + i}) 555-{1000 + i} and +1 ({200 + i}) 555-{1000 + i} or 10.0.0.{i} v {i * 37}", "en", "a") for i in range(80)]
    docs = make(spark, rows)
    for r in pii.find(docs.where("doc_id < 1000"), pii.fit(docs, steps=40)).collect():
        assert "phone:5:19" in r["spans"].split(",")


def test_a_single_node_and_none():
    for text in ("only 7 here", "nothing"):
        part = next(pii.chunks(pii.pa.array([text])))
        assert pii.added_spans(pii.Field.blank(), pii.nodes_of(part, [[]]), [[]]) == []


def test_national_phones_are_learnt(spark):
    rows = [(i, f"text ({200 + i}) 555-{1000 + i} and +1 ({200 + i}) 555-{1000 + i} or 10.0.0.{i} v {i * 37}", "en", "a") for i in range(80)]
    docs = make(spark, rows)
    for r in pii.find(docs, pii.fit(docs)).collect():
        assert "phone:5:19" in r["spans"].split(",") and r["n_phone"] == 1


def test_odd_rows(odd, empty):
    rows = pii.find(odd, pii.fit(odd)).collect()
    assert len(rows) == odd.count() and all(r["base"] == "" for r in rows if r["doc_id"] in (1, 2, 3, 4))
    assert pii.find(empty, pii.fit(empty)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_very_long_runs_stay_fast():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000):
        pii.base_spans(text)
