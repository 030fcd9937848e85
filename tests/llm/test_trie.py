import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from semaspark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, sig string, depth string, id string, up string"


def talk(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "a", "b", "c", "d") for c, t, r, x in rows], SCHEMA)


def report(df):
    return [tuple(r) for r in trie.trie_report(trie.rebuilt(trie.own_turns(df))).collect()]


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - c % 20, [])[:h] + mine[h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = sum(saved[k] for k in kids.get(node, [])) + (len(members[node]) - 1) * words(node)
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same(spark, rows):
    got, want = sorted(report(talk(spark, rows)), key=repr), sorted(brute(rows), key=repr)
    assert got == want


def test_like_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    r = con.execute(trie.OP11_SQL)
    names = [c[0] for c in r.description]
    got = trie.op11_trie(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(r.fetchall(), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(0, 90):
        n = rng.choice([1, 2, 3, 5, 9, 17])
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "a b", ""])) for t in range(n)]
    same(spark, rows)


def test_prefix_chains_copies_and_cuts(spark):
    long = [("user", f"w{i} x") for i in range(40)]
    rows = []
    for k, n in enumerate((40, 1, 2, 3, 31, 32, 33, 40, 16, 8)):
        rows += [(20 * k, t, r, x) for t, (r, x) in enumerate(long[:n])]
    # Leaves the long path in the middle of an edge, twice at the same place.
    for k in (30, 31):
        rows += [(20 * k, t, r, x) for t, (r, x) in enumerate([*long[:20], ("user", f"other {k}"), ("user", "end")])]
    same(spark, rows)


def test_odd_rows(spark):
    rows = [(0, None, "u", "first"), (0, 1, "u", "second"), (1, 5, None, None), (1, 5, None, None), (2, 1, "u", "b"), (2, 1, "u", "a"), (None, 1, "u", "lost"),
            (7, 1, "", "one turn"), (41, 1, "u", "no family"), (60, 1, "u", "word " * 30_000), (3, 2, "é", "é é"), (-21, 1, "u", "minus"), (2**62, 0, "u", "far")]
    got = report(talk(spark, rows))
    assert {r[3] for r in got if r[1] == 0} == {9}
    want = brute([r for r in rows if r[0] is None or r[0] >= 0])
    assert sorted(report(talk(spark, [r for r in rows if r[0] is None or r[0] >= 0])), key=repr) == sorted(want, key=repr)
    assert report(talk(spark, [])) == [] and report(talk(spark, [(None, 1, "u", "x")])) == []


def test_turnless_conversations_only(spark):
    # A conversation whose only turn falls under the shared ones, and whose family has no first conversation.
    alone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:2]
    got = report(talk(spark, [(c, 1, "u", "x") for c in alone]))
    ends = hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    assert got == [(alone[0], 0, None, 2, 0, 1, 0, ends)]


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for a, b, f in df.select("a", "b", trie.two_fattest(df.a, df.b)).collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_prefix_signatures_depend_on_the_prefix_only():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (7, 2)).astype(np.uint64)
    both = trie.prefix_signatures(np.concatenate((a, a[:3], a)), np.array([0, 7, 10, 10, 17]))
    assert (both[:7] == both[10:17]).all() and (both[7:10] == both[:3]).all() and len(np.unique(both[:7], axis=0)) == 7
    assert trie.prefix_signatures(np.zeros((0, 2), np.uint64), np.array([0])).shape == (0, 2)
