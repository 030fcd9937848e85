import re

import pytest
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Names that the operators use inside, as extra columns of other types.
CLASHES = ("salt", "join_key", "q", "doc_key", "text_key", "gone", "left_over", "full", "cut", "copies", "class_id", "node", "NTH", "size", "h", "target")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *("x" for _ in CLASHES)) for i, t, lang, src in rows], DOCS)


LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(6_000))

ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (None, "a b c d e f g", "en", "b"),
    (5, LONG, "en", "b"), (6, "x\ny\nz\nw", "fr", "b"), (6, "x\ny\nz\nw", "fr", "b"), (7, "x\ny\nz\nw", "fr", "b"), (8, "é " * 40, "xx", "é"), (9, "the quick brown fox " * 9, "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
