import random
from collections import Counter, defaultdict

import numpy as np

from conftest import WORD, make
from semaspark.llm import neardup
from semaspark.llm.components import components


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = Counter((a, b) for ids in where.values() for n, b in enumerate(ids) for a in ids[:n])
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_like_brute_force(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(documents).collect()}
    assert got == brute(texts)


def test_large_groups_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(300)]
    rows = [(0, " ".join(base), "en", "a")]
    for i in range(1, 120):
        w = list(base)
        for at in rng.sample(range(300), 6):  # each is near the base; two of them need not be near each other
            w[at] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", "a"))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(1000 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(200)), "en", "a") for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(spark, rows)).collect()}
    assert got == brute({r[0]: r[1] for r in rows})


def test_odd_rows(odd, empty):
    got = [(r["doc_id"], r["class_id"]) for r in neardup.classes(odd).collect()]
    assert len(got) == odd.count()
    assert {i: c for i, c in got if i} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9} and (None, None) in got
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 6, 8, 9]


def test_alignment():
    a = np.arange(1000, dtype=np.uint32)
    b = np.concatenate((a[:100], a[105:500], np.arange(5000, 5010, dtype=np.uint32), a[500:]))
    assert neardup.aligned_words(a, b, 200) == 995 and neardup.aligned_words(a, a, 1) == 1000
    assert neardup.aligned_words(a, a[::-1], 200) < 300 and neardup.aligned_words(a[:0], a, 5) == 0
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert neardup.aligned_words(np.array(x, np.uint32), np.array(y, np.uint32), 30) == best[-1][-1]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(200, 100), (300, 200), (7, 7), (100, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda k: [f"u{rng.randrange(10**7)}" for _ in range(k)]
    passage = own(150)
    texts = {i: passage + own(60) for i in range(150)}
    texts |= {1000 + i: texts[i][:-1] + own(1) for i in range(0, 150, 10)}  # near texts among them are still found
    counted, links = [], neardup._links
    monkeypatch.setattr(neardup, "_links", lambda pairs, words: counted.append(pairs.count()) or links(pairs, words))
    rows = [(i, " ".join(w), "en", "a") for i, w in texts.items()]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(spark, rows)).collect()}
    assert got == brute({r[0]: r[1] for r in rows}) and len(set(got.values())) == 150
    assert sum(counted) < 10 * len(texts)


def test_rare_buckets_lose_no_near_pair(spark):
    rng = random.Random(7)
    lines = [" ".join(f"l{rng.randrange(10**6)}" for _ in range(6)) for _ in range(12)]
    texts = {i: " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for i in range(150)}
    texts |= {500 + i: " ".join(texts[i].split()[: rng.randrange(3, 400)]) for i in range(150)} | {900: "a b", 901: "a b", 902: "a"}
    words = spark.createDataFrame(list(texts.items()), "node long, t string").select("node", neardup.word_codes("t").alias("codes"))
    made = defaultdict(list)
    for r in neardup.rare_buckets(words.selectExpr("node", "node as root"), words).collect():
        made[r["bucket"]].append(r)
    meet = {(x["node"], y["node"]) for b in made.values() for x in b for y in b
            if x["node"] < y["node"] and x["other"] == y["size"] and 9 * min(x["room"], y["room"]) >= 4 * (x["n"] + y["n"])}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    near = {(i, j) for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert near and near <= meet and len(meet) < len(sets) * (len(sets) - 1) // 4
