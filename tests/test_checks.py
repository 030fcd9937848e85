"""The registered queries: every operator has one, and the quick ones agree with their SQL here."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES
from checks.run import TABLES, compare

QUICK = ("flagship", "m1_", "m6_", "m14_", "m16_", "q4_", "q8_", "j4_", "t3_", "a13_", "w2_", "v6_", "v7_", "c3_", "e13_", "x3_", "x17_", "p8_", "p10_")

# The operators of the blueprint that a query must stand for.
OPERATORS = {"s": 8, "m": 18, "q": 10, "j": 6, "t": 3, "a": 16, "w": 9, "v": 9, "c": 5, "e": 16, "x": 18, "p": 10}
TOGETHER = {"m7_m11": range(7, 12), "a10_a11": range(10, 12)}


def test_every_operator_is_registered():
    have = set()
    for name in entry.queries():
        found = re.match(r"([a-z])(\d+)_", name)
        if found:
            have.add((found[1], int(found[2])))
        for prefix, numbers in TOGETHER.items():
            if name.startswith(prefix):
                have |= {(name[0], n) for n in numbers}
    assert not {(k, i) for k, n in OPERATORS.items() for i in range(1, n + 1)} - have


def test_every_query_has_sql():
    """Operators over documents are tested against brute force where SQL cannot say what they do."""
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) - set(QUERIES) == set(entry.CORPUS_QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith(QUICK)])
def test_against_sql(spark, con, sf, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 5
