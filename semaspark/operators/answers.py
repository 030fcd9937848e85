"""Run many query texts, each in the name space of its database, and judge their answers in one job.

Every database gets a session of its own, so tables of one name in two databases never meet. Equal texts over
one database run once, however many questions and providers ask them. A bounded number of texts runs at a
time; each has a job tag, and one that passes its time limit is interrupted by that tag until it ends, while the others
go on; it gets a second run when nothing else runs. Jobs are interrupted, not the analysis of a text; the tag is one of the Spark context, as those of a session are
known to their own thread only. A task that never looks whether it was killed is left to ``spark.task.reaper``.

Answers are normalised and appended to one folder of the shared storage, a subfolder each, and read back as one
table: no plan grows with the number of texts. The driver streams the texts and keeps their headers in parts of
``HEADS`` rows.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.functions.normalize import normalize_frame
from semaspark.operators.batch_compare import compare_rows
from semaspark.operators.compare import GOLD, PRED, _tagged, broken, order_matters, query_only
from semaspark.operators.evaluate import extract_sql, failure_rows, merge_results, pending, with_schema
from semaspark.session import cut_lineage, sized, staging_path

HEADS = 512
TIMED_OUT = "Query timed out"
SETTINGS = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")
ROWS = T.StructType([T.StructField("pos", T.LongType()), T.StructField("vals", T.ArrayType(T.StringType())), T.StructField("answer", T.LongType())])
HEADERS = "answer long, n_cols int, error string, seconds double"

Open = Callable[[str], SparkSession]


def one_session(spark: SparkSession) -> Open:
    """All databases are the present session."""
    return lambda db_id: spark


def located(spark: SparkSession, locations: DataFrame, keep: int = 16) -> Open:
    """A session per database over tables at ``locations`` (db_id, table_name, path). The last ``keep`` sessions
    stay open; the tables of one database are what is read to the driver."""
    opened: OrderedDict[str, SparkSession] = OrderedDict()
    lock = threading.Lock()

    def open_(db_id: str) -> SparkSession:
        with lock:
            if db_id not in opened:
                session = spark.newSession()
                for key in SETTINGS:
                    session.conf.set(key, spark.conf.get(key))
                for r in locations.filter(F.col("db_id") == db_id).collect():
                    session.read.parquet(r["path"]).createOrReplaceTempView(r["table_name"])
                opened[db_id] = session
                if len(opened) > keep:
                    opened.popitem(last=False)
            opened.move_to_end(db_id)
            return opened[db_id]

    return open_


@dataclass(frozen=True)
class Answers:
    """texts    db_id, sql, answer
    headers  answer, n_rows, n_cols, error, seconds: one row per text
    rows     answer, pos (0, 1, 2, … in the order of the answer), vals (normalised)"""

    texts: DataFrame
    headers: DataFrame
    rows: DataFrame


def _limited(session: SparkSession, limit: float, work: Callable[[], None]) -> None:
    """Run ``work`` in this thread; after ``limit`` seconds its jobs are interrupted until it ends."""
    context, tag, done, late = session.sparkContext, f"text-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(limit):
            return
        late.set()
        # Between two jobs of a text there is nothing to interrupt: try again until it has ended.
        while not done.is_set():
            context.cancelJobsWithTag(tag)
            done.wait(0.2)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        work()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(TIMED_OUT) from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def _run_one(open_: Open, answer: int, db_id: str, sql: str, folder: str, limit: float) -> tuple[int, int, str | None, float]:
    began, n_cols = time.monotonic(), 0

    def work() -> None:
        nonlocal n_cols
        found = normalize_frame(query_only(session, sql))
        n_cols = len(found.columns)
        vals = F.array(*[_tagged(F.col(c)) for c in found.columns])
        found.select(F.monotonically_increasing_id().alias("pos"), vals.alias("vals")).write.mode("overwrite").parquet(f"{folder}/answer={answer}")

    try:
        session = open_(db_id)
        _limited(session, limit, work)
        return answer, n_cols, None, time.monotonic() - began
    except Exception as error:  # a wrong text must not stop the others
        return answer, n_cols, str(error).strip() or type(error).__name__, time.monotonic() - began


def _pooled(jobs: Iterable[Callable[[], tuple]], workers: int) -> Iterator[tuple]:
    """Results as they come; at most twice ``workers`` jobs are held."""
    with ThreadPoolExecutor(workers) as pool:
        open_: set[Future] = set()
        for job in jobs:
            open_.add(pool.submit(job))
            if len(open_) >= 2 * workers:
                ended, open_ = wait(open_, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in ended)
        yield from (f.result() for f in open_)


def run_texts(spark: SparkSession, texts: DataFrame, open_: Open, limit: float = 30, workers: int = 4) -> Answers:
    """Run each distinct (db_id, sql) of ``texts`` for at most ``limit`` seconds. A text that was cut beside others may only have waited
    for them: it runs again alone, so the limit is its own."""
    distinct = texts.select("db_id", "sql").distinct().repartitionByRange("db_id", "sql").sortWithinPartitions("db_id", "sql")
    numbered = cut_lineage(distinct.withColumn("answer", F.monotonically_increasing_id()))
    folder, heads = staging_path(spark, "answers"), staging_path(spark, "headers")
    batch: list[tuple] = []
    late: list[tuple[int]] = []

    def jobs(rows: DataFrame) -> Iterator[Callable[[], tuple]]:
        return ((lambda r=r: _run_one(open_, r["answer"], r["db_id"], r["sql"], folder, limit)) for r in rows.toLocalIterator())

    def heads_of() -> Iterator[tuple]:
        for head in _pooled(jobs(numbered), workers):
            if head[2] == TIMED_OUT and workers > 1:
                late.append((head[0],))
            else:
                yield head
        if late:
            alone = numbered.join(spark.createDataFrame(late, "answer long"), "answer", "left_semi")
            yield from (job() for job in jobs(alone))

    def flush() -> None:
        spark.createDataFrame(batch, HEADERS).coalesce(1).write.mode("append").parquet(heads)
        batch.clear()

    any_rows = False
    for head in heads_of():
        any_rows |= head[2] is None
        batch.append(head)
        if len(batch) == HEADS:
            flush()
    flush()
    headers = spark.read.schema(spark.createDataFrame([], HEADERS).schema).parquet(heads)
    rows = spark.read.schema(ROWS).parquet(folder) if any_rows else spark.createDataFrame([], ROWS)
    return _placed(numbered, headers, rows)


def _placed(texts: DataFrame, headers: DataFrame, rows: DataFrame) -> Answers:
    """Row numbers without gaps, for all answers at once: a row knows its task and its place there, and
    what comes before a task is summed over one row per answer and task. Rows of a text that failed are not taken."""
    good, _ = sized(headers.filter("error is null").select("answer"))
    part = F.shiftright("pos", 33).alias("part")
    rows = rows.join(good, "answer", "left_semi").withColumn("part", part)
    sizes = cut_lineage(rows.groupBy("answer", "part").agg(F.count("*").alias("size")))
    before = F.sum("size").over(Window.partitionBy("answer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets, _ = sized(sizes.select("answer", "part", F.coalesce(before, F.lit(0)).alias("before")))
    placed = rows.join(offsets, ["answer", "part"]).select("answer", (F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")).alias("pos"), "vals")
    counted = headers.join(sizes.groupBy("answer").agg(F.sum("size").alias("n")), "answer", "left")
    n_rows = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))
    return Answers(texts, counted.select("answer", n_rows.cast("long").alias("n_rows"), "n_cols", "error", "seconds"), placed)


def judge(answers: Answers, pairs: DataFrame, strict_order: bool = False) -> DataFrame:
    """``question_id, match, error`` for pairs (question_id, db_id, predicted, gold); question_id is unique.
    Pairs of the same two texts are compared once."""
    ids = answers.texts
    both = pairs.join(ids.select("db_id", F.col("sql").alias("predicted"), F.col("answer").alias("p")), ["db_id", "predicted"])
    both = both.join(ids.select("db_id", F.col("sql").alias("gold"), F.col("answer").alias("g")), ["db_id", "gold"])
    both = cut_lineage(both.select("question_id", "p", "g", order_matters(F.col("gold"), strict_order).alias("ordered")))
    once = cut_lineage(both.groupBy("p", "g").agg(F.min("question_id").alias("pair"), F.bool_or("ordered").alias("ordered")))
    sides = F.explode(F.array(F.struct(F.lit(PRED).alias("side"), F.col("p").alias("answer")), F.struct(F.lit(GOLD).alias("side"), F.col("g").alias("answer"))))
    used = cut_lineage(once.select(F.col("pair").alias("question_id"), "ordered", sides.alias("s")).select("question_id", "ordered", "s.*"))
    heads = used.join(answers.headers, "answer").select("question_id", "side", "n_rows", "n_cols", "error", "ordered")
    wanted, _ = sized(used.select("answer", "question_id", "side", "ordered"))
    rows = answers.rows.join(wanted, "answer").select("question_id", "side", F.when(F.col("ordered"), F.col("pos")).otherwise(F.xxhash64("pos", "vals")).alias("pos"), "vals")
    verdicts = compare_rows(heads, rows)
    return both.join(once.select("p", "g", "pair"), ["p", "g"]).join(verdicts.withColumnRenamed("question_id", "pair"), "pair").select("question_id", "match", "error")


def _all_texts(pairs: DataFrame) -> DataFrame:
    return pairs.select("db_id", F.explode(F.array("predicted", "gold")).alias("sql"))


def compare_databases(spark: SparkSession, pairs: DataFrame, open_: Open, strict_order: bool = False, limit: float = 30, workers: int = 4) -> DataFrame:
    """Verdicts ``question_id, match, error`` for pairs (question_id, db_id, predicted, gold), each over its own database."""
    pairs = cut_lineage(pairs.select("question_id", "db_id", "predicted", "gold"))
    return judge(run_texts(spark, _all_texts(pairs), open_, limit, workers), pairs, strict_order)


def compare_pairs(spark: SparkSession, pairs: Iterable[tuple[int, str, str]], strict_order: bool = False, limit: float = 30, workers: int = 4) -> DataFrame:
    """Verdicts for (question_id, predicted, gold) texts over the tables of the present session."""
    rows = [(q, "", predicted, gold) for q, predicted, gold in pairs]
    asked = spark.createDataFrame(rows, "question_id int, db_id string, predicted string, gold string")
    return compare_databases(spark, asked, one_session(spark), strict_order, limit, workers)


def self_check(spark: SparkSession, queries: DataFrame, open_: Open, limit: float = 30, workers: int = 4) -> DataFrame:
    """``question_id, case, match`` for queries (question_id, db_id, sql): each against itself must match, and against a
    broken version of itself must not. What breaks a text depends on whether it has rows; both rounds run their texts together."""
    queries = cut_lineage(queries.select("question_id", "db_id", "sql"))
    first = run_texts(spark, queries, open_, limit, workers)
    sized_ = queries.join(first.texts, ["db_id", "sql"]).join(first.headers.select("answer", "n_rows"), "answer")
    cases = F.explode(F.array(F.struct(F.lit("same").alias("case"), F.col("sql").alias("predicted")),
                              F.struct(F.lit("broken").alias("case"), broken(F.col("sql"), F.coalesce("n_rows", F.lit(0)) == 0).alias("predicted"))))
    pairs = cut_lineage(sized_.select(F.col("question_id").alias("asked"), "db_id", F.col("sql").alias("gold"), cases.alias("c")).select(
        F.monotonically_increasing_id().alias("question_id"), "asked", "db_id", "gold", "c.*"))
    verdicts = compare_databases(spark, pairs, open_, limit=limit, workers=workers)
    return pairs.join(verdicts, "question_id").select(F.col("asked").alias("question_id"), "case", "match")


RESULT = ("provider", "question_id", "db_id", "question", "gold_sql", "predicted_sql", "match", "error", "latency_ms")


def run_evaluation(spark: SparkSession, questions: DataFrame, replies: DataFrame, schemas: DataFrame, open_: Open, done: DataFrame | None = None,
                   limit: float = 30, workers: int = 4) -> DataFrame:
    """Results of all providers, as ``RESULT`` names them.

    ``questions``: question_id, db_id, question, gold_sql; ``replies``: provider, question_id, reply, error, latency_ms;
    ``schemas``: the databases that are known. Questions without a schema are left out. A (provider, question_id) of ``done`` keeps its
    earlier result and is not run. A reply that failed at its provider counts as an error and is not run either."""
    asked = with_schema(questions, schemas).join(replies, "question_id")
    if done is not None:
        asked = pending(asked, done, ("provider", "question_id"))
    asked = cut_lineage(asked.withColumn("predicted_sql", extract_sql(F.coalesce("reply", F.lit("")))).withColumn("row_id", F.monotonically_increasing_id()))
    ran = asked.filter("error is null")
    verdicts = compare_databases(spark, ran.select(F.col("row_id").alias("question_id"), "db_id", F.col("predicted_sql").alias("predicted"), F.col("gold_sql").alias("gold")),
                                 open_, limit=limit, workers=workers)
    judged = ran.drop("error").join(verdicts.withColumnRenamed("question_id", "row_id"), "row_id").select(*RESULT)
    failed = failure_rows(asked.filter("error is not null").withColumn("match", F.lit(False))).select(*RESULT)
    new = judged.unionByName(failed)
    return new if done is None else merge_results(done.select(*RESULT), new)
