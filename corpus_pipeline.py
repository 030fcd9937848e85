"""Documents to packed training sequences: five stages, each over all that the stage before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). ``run`` writes each result as Parquet
into the shared folder and reads it back for the next stage. Nulls, empty texts and extra columns are handled as
the operators' docstrings say; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import stage, table
from semaspark.llm.linededup import drop_repeats
from semaspark.llm.mixing import mix
from semaspark.llm.neardup import keep_one
from semaspark.llm.packing import pack_documents
from semaspark.llm.quality import keep_good

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the perplexity band of their language go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows that an earlier document or place has already go; a document emptied by that goes too."""
    left = drop_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources over their target are left out, those of sources below it are repeated."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the offset they go to; a repeated document is packed as often as it comes."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
