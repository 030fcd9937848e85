import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from conftest import make
from semaspark.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted((s for k, s in groups if k == lang), key=lambda s: s.encode())
        of = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(of[s][t] for s in sources) for t in kept}

        def p(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (n + 2) // total for t, n in counts.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        shares, q = {s: p(of[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            terms = sorted((-f(shares[s][t], q[t]), t.encode()) for t in kept if of[s][t] and shares[s][t] > q[t])[:10]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = con.execute(dv.OP13_SQL)
    names = [c[0] for c in r.description]
    assert sorted(map(tuple, dv.op13_divergence(spark, sf).select(*names).collect())) == sorted(r.fetchall())


def test_terms_of_all_lengths_like_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "Ab", "abcdefgh", "abcdefghi", "ABCDEFGHIJKLMNOP", "abcdefghijklmnopq", "é" * 4, "é" * 8, "日本語" * 6, "x" * 17, "x" * 40, "y" * 40, "it's", "a1b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s", "S", "é", None])) for i in range(150)]
    rows += [(1, None, "none", "a"), (1, "", "none", "b"), (2, "x", "one", "a"), (2, "long " * 20_000, "fr", "é"), (2, "y" * 100_000, "fr", "é")]
    for least in (1, 3, 10):
        got = sorted(map(tuple, dv.audit(make(spark, rows), least_docs=least).collect()))
        assert got == brute(rows, least)


def test_odd_rows(spark, odd, empty):
    assert dv.audit(empty).count() == 0
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert sorted(map(tuple, dv.audit(odd, least_docs=1).collect())) == brute(rows, 1)
    assert [tuple(r) for r in dv.audit(odd).collect()] == brute(rows)


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 3, 5000).astype(np.uint64)
    low[:3000] &= np.uint64(0xFF00000000FF)
    assert (dv.radix_order([low, high]) == np.lexsort((low, high))).all()


def test_shares_are_exact():
    rng = random.Random(1)
    counts = [0, 1, 10**6, 8 * 10**15] + [rng.randrange(10**12) for _ in range(100)]
    totals = [2, 3, 10**7, 8 * 10**15 + 4] + [rng.randrange(10**12, 10**13) for _ in range(100)]
    got = dv.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(counts, totals)]
