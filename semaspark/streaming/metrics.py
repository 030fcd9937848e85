"""Metrics that follow results as they arrive."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from semaspark.session import staging_path

RESULT_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("provider", T.StringType()), T.StructField("match", T.BooleanType()),
    T.StructField("error", T.StringType()), T.StructField("event_time", T.TimestampType())])
STATE_SCHEMA = T.StructType([
    T.StructField("window_start", T.TimestampType()), T.StructField("provider", T.StringType()), T.StructField("total", T.LongType()),
    T.StructField("correct", T.LongType()), T.StructField("errors", T.LongType())])


def stream_metrics(results: DataFrame, window: str = "1 day", watermark: str = "40 days") -> DataFrame:
    """Totals per window and provider over a stream of results, each question counted once even if
    it is delivered again within the watermark."""
    once = results.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["question_id"])
    return once.groupBy(F.window("event_time", window).alias("w"), "provider").agg(
        F.count("*").alias("total"), F.count_if("match").alias("correct"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors")).select(
        F.col("w.start").alias("window_start"), "provider", "total", "correct", "errors")


class LateRows(StreamingQueryListener):
    """Rows that each trigger of a query left out because they came behind its watermark, as Spark reports them.

    A trigger that is run again replaces its count; a trigger without late rows has none."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], int] = {}
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        if late:
            self.counts[str(event.progress.id), event.progress.batchId] = late

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)].set()

    def of(self, query: StreamingQuery) -> dict[int, int]:
        return {batch: n for (one, batch), n in sorted(self.counts.items()) if one == str(query.id)}


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole states under ``path``, in order; one that is still being written is none."""
    folder, fs = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(folder)]
    numbers = sorted(int(n.removeprefix("state-")) for n in names if n.startswith("state-"))
    return [n for n in numbers if fs.exists(_files(spark, f"{path}/state-{n}/_SUCCESS")[0])]


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state-{number}")


def write_updates(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every trigger merges its changed windows into the state before it and writes the whole as a new generation.

    The last two generations stay: a trigger that is run again starts from the one before it, and a reader of the one
    before is not disturbed. So what ``latest`` reads has one row per window and provider, however many triggers ran."""
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in generations(spark, path) if n < batch_id]
        # The changed windows are read once: a union and a sum by key, not a join of them with themselves.
        rows = batch.select(*STATE_SCHEMA.names, F.lit(1).alias("turn"))
        if before:
            rows = rows.unionByName(_state(spark, path, before[-1]).withColumn("turn", F.lit(0)))
        merged = rows.groupBy("window_start", "provider").agg(F.max_by(F.struct("total", "correct", "errors"), "turn").alias("m"))
        merged.select("window_start", "provider", "m.*").write.mode("overwrite").parquet(f"{path}/state-{batch_id}")
        for old in before[:-1]:
            folder, fs = _files(spark, f"{path}/state-{old}")
            fs.delete(folder, True)

    return (metrics.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last state of every window and provider; no rows before the first trigger has ended."""
    done = generations(spark, path)
    return _state(spark, path, done[-1]) if done else spark.createDataFrame([], STATE_SCHEMA)


def run_available(spark: SparkSession, metrics: DataFrame, folder: str | None = None) -> DataFrame:
    """Process what has arrived, then return the state; files live in the shared folder, or in ``folder``, where a
    later call goes on."""
    return run_counted(spark, metrics, folder)[0]


def run_counted(spark: SparkSession, metrics: DataFrame, folder: str | None = None, wait: float = 30) -> tuple[DataFrame, DataFrame]:
    """``run_available`` and a table ``batch_id, late``: how many rows each trigger of this call left out as too late."""
    base, heard = folder or staging_path(spark, "stream"), LateRows()
    spark.streams.addListener(heard)
    try:
        query = write_updates(metrics, f"{base}/updates", f"{base}/checkpoint")
        query.awaitTermination()
        if not heard.ended[str(query.id)].wait(wait):
            raise TimeoutError("the end of the query was not reported; its late rows are not known")
    finally:
        spark.streams.removeListener(heard)
    return latest(spark, f"{base}/updates"), spark.createDataFrame(list(heard.of(query).items()), "batch_id bigint, late bigint")
