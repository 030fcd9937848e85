"""Session helpers: the shared folder that cuts lineage and holds staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have to be sent to every executor: names, ranks and verdicts of this many
# rows stay well below the memory of a task.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder; on a cluster a missing setting is an error, because
    a machine-local folder would lose data with the machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="semaspark-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps of a loop neither
    recompute it nor see other values if an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_rows(df: DataFrame, label: str) -> DataFrame:
    """``cut_lineage`` for many rows: Parquet files take a small part of what a checkpoint does, which is not compressed."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Stage a side table and count it. If it has at most ``limit`` rows it comes back marked for
    broadcast, with True; otherwise as it is, with False, for a join that shuffles."""
    staged = cut_lineage(df)
    if staged.limit(limit + 1).count() <= limit:
        return F.broadcast(staged), True
    return staged, False
