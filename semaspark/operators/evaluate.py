"""Evaluation runs as tables: difficulty, samples, prompts and answers, resume, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semaspark.functions.exact import exact_avg
from semaspark.functions.normalize import let
from semaspark.operators.compare import metrics, with_positions
from semaspark.operators.selection import exact_percentiles, first_per_group, join_groups


def difficulty(ast: Column) -> Column:
    """easy, medium, hard or extra, from the JSON text of a parsed query.

    A set operation makes it extra; a query nested in FROM or WHERE makes it hard; grouping
    makes it hard over several tables and medium over one; several tables or an order make it
    medium. Text that is no JSON has no class."""
    fields = ("union", "intersect", "except", "where", "groupBy", "orderBy", "having")
    shape = "from struct<table_units: array<array<string>>>, " + ", ".join(f"`{n}` string" for n in fields)
    return let(F.from_json(ast, shape), lambda q: F.when(F.try_parse_json(ast).isNotNull(), _class_of(q)))


def _class_of(q: Column) -> Column:
    def filled(name: str) -> Column:
        return F.coalesce(~q[name].isin("[]", "{}", "", "false", "0"), F.lit(False))

    # An object that is not inside a string literal is a nested query.
    where = F.regexp_replace(F.coalesce(q["where"], F.lit("")), r'"(?:[^"\\]|\\.)*"', "")
    nested = where.contains("{")
    units = q["from"]["table_units"]
    nested_from = F.coalesce(F.exists(units, lambda u: F.get(u, F.lit(0)) == "sql"), F.lit(False))
    several = F.coalesce(F.size(units), F.lit(0)) > 1
    set_op = q["union"].isNotNull() | q["intersect"].isNotNull() | q["except"].isNotNull()
    grouped = filled("groupBy") | filled("having")
    return (F.when(set_op, "extra").when(nested_from | nested, "hard").when(grouped & several, "hard")
            .when(grouped | several | filled("orderBy"), "medium").otherwise("easy"))


def difficulty_distribution(questions: DataFrame, col: str = "difficulty") -> DataFrame:
    return questions.groupBy(col).agg(F.count("*").alias("questions"))


def stratified_sample(df: DataFrame, stratum: str, n: int, key: str, seed: int = 42, strict: bool = True) -> DataFrame:
    """``n`` rows of every stratum, the same on every run and every partitioning: rows are ordered
    by a hash of key and seed. ``strict`` stops the job if a stratum is short."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    sample = first_per_group(df.withColumn("draw", draw), [stratum], [F.col("draw"), F.col(key)], n, [key])
    if strict:
        # The sample is already grouped by stratum: counting it moves nothing.
        have = F.count("*").over(Window.partitionBy(stratum))
        text = F.concat(F.lit("not enough rows in "), F.col(stratum).cast("string"), F.lit(": "), F.col("__have").cast("string"))
        sample = sample.withColumn("__have", have).filter(F.when(F.col("__have") >= n, F.lit(True)).otherwise(F.raise_error(text))).drop("__have")
    return sample.drop("rank")


def shuffled_ids(sample: DataFrame, key: str, seed: int = 42, name: str = "id") -> DataFrame:
    """Ids 0, 1, 2, … in a shuffled order that depends only on key and seed; no task sees all rows."""
    draw = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return with_positions(sample.orderBy(draw, key), name)


def missing(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct keys that have no row in the reference."""
    return df.select(key).distinct().join(reference.select(key), key, "left_anti")


def sample_stats(sample: DataFrame, by: Sequence[str], top: str, n: int = 5) -> DataFrame:
    """``dimension, value, questions``: counts by each column of ``by``, and the ``n`` largest of ``top``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in [*by, top]]))
    counts = sample.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("questions"))
    most = counts.filter(F.col("dimension") == top).orderBy(F.desc("questions"), "value").limit(n)
    return counts.filter(F.col("dimension") != top).unionByName(most)


def build_prompts(questions: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``prompt`` to questions whose database has a schema text."""
    # The wording of a prompt.
    parts = (F.lit("Given the following database schema:"), F.col("schema_text"),
             F.concat(F.lit("Write a SQL query to answer this question: "), F.col("question")),
             F.lit("Return only the SQL query, no explanation. Do not wrap in markdown code blocks."))
    return questions.join(schemas, "db_id").withColumn("prompt", F.concat_ws("\n\n", *parts)).drop("schema_text")


def extract_sql(answer: Column) -> Column:
    """The query inside an answer: an opening fence and a closing fence are taken off."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(F.regexp_replace(text, "^```(sql)?", ""), "```$", "")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pending(questions: DataFrame, done: DataFrame, key: str | Sequence[str] | None = None) -> DataFrame:
    """The rows of ``questions`` whose key has no result yet. The key is the question, of its provider where both tables name one:
    the results of one provider do not hide what is open for another."""
    if key is None:
        key = [c for c in ("provider", "question_id") if c in questions.columns and c in done.columns]
    keys = [key] if isinstance(key, str) else list(key)
    return questions.join(done.select(*keys), keys, "left_anti")


def merge_results(done: DataFrame, new: DataFrame, key: str | Sequence[str] = ("provider", "question_id")) -> DataFrame:
    """Earlier results stay as they are; new ones are added for questions without one by the same provider."""
    return done.unionByName(pending(new, done, key))


def with_schema(questions: DataFrame, schemas: DataFrame) -> DataFrame:
    return questions.join(schemas.select("db_id"), "db_id", "left_semi")


def without_schema(questions: DataFrame, schemas: DataFrame) -> DataFrame:
    """The questions ``with_schema`` leaves out, for the warning list."""
    return questions.join(schemas.select("db_id"), "db_id", "left_anti")


def failure_rows(answers: DataFrame, prefix: str = "LLM error: ") -> DataFrame:
    """Answers that failed at the provider: no query, no match, and a marked error."""
    failed = F.col("error").isNotNull()
    return (answers.withColumn("predicted_sql", F.when(failed, F.lit("")).otherwise(F.col("predicted_sql")))
            .withColumn("match", F.when(failed, F.lit(False)).otherwise(F.col("match")))
            .withColumn("error", F.when(failed, F.concat(F.lit(prefix), F.col("error")))))


def leaderboard(results: DataFrame) -> DataFrame:
    return metrics(results, ["provider"]).orderBy(F.desc("accuracy"), "provider")


def latency_stats(results: DataFrame, approximate: bool = False, scale: int | None = None) -> DataFrame:
    """``provider, n, mean, median, p95`` of ``latency_ms``. Exact percentiles cost two passes;
    ``approximate`` trades them for one. With ``scale``, values have that many decimals and their mean does not
    depend on the order of rows; without it the mean is that of the doubles as they are."""
    latency = F.col("latency_ms")
    mean = F.avg(latency.cast("double")) if scale is None else exact_avg(latency, scale)
    base = results.groupBy("provider").agg(F.count("latency_ms").alias("n"), mean.alias("mean"))
    if approximate:
        marks = results.groupBy("provider").agg(*[F.percentile_approx("latency_ms", p).alias(n) for n, p in (("median", 0.5), ("p95", 0.95))])
    else:
        marks = exact_percentiles(results, ["provider"], "latency_ms", {"median": 0.5, "p95": 0.95})
    return join_groups(base, marks, ["provider"], "left")


def attribute_errors(full: DataFrame, minimal: DataFrame) -> DataFrame:
    """``question_id, cause`` from the same questions over the full and the minimal model."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("question_id", F.col("match").alias(f"{tag}_match"), F.coalesce("error", F.lit("")).alias(f"{tag}_error"))

    both = side(full, "full").join(side(minimal, "minimal"), "question_id", "full")
    ok = lambda c: F.coalesce(F.col(f"{c}_match"), F.lit(False))
    failed = lambda c: F.coalesce(F.col(f"{c}_error"), F.lit("")) != ""
    cause = (F.when(ok("full"), "none")
             .when(F.lower("full_error").contains("join"), "missing join")
             .when(ok("minimal"), "column selection")
             .when(failed("full") & failed("minimal"), "syntax")
             .otherwise("logic"))
    return both.select("question_id", cause.alias("cause"))


def accuracy_by(results: DataFrame, by: Sequence[str], z: float = 1.96) -> DataFrame:
    """Accuracy per group with its Wilson interval ``low, high``."""
    counted = metrics(results, by)
    n, p = F.col("total").cast("double"), F.col("accuracy")
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) * z / (1 + z2 / n)
    return counted.select(*by, "total", "correct", "accuracy", (centre - half).alias("low"), (centre + half).alias("high"))
