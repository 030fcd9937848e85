"""Evaluation analytics, streaming metrics and cost tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import (CATALOG_SQL, RESULTS_SQL, STEPS, USAGE_SQL, catalogs, log_catalog, prices, results, usage)
from checks.registry import query, table, xavg
from semaspark.operators import cost as P
from semaspark.operators import evaluate as X
from semaspark.session import staging_path
from semaspark.sources.catalog import render_schema
from semaspark.streaming import metrics as S

HAS_SET = "l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40"
PARSED = f"""'{{"from": {{"table_units": [' || CASE WHEN l_linenumber = 7 THEN '["sql", {{"from": {{}}}}]' WHEN l_suppkey % 2 = 0 THEN '["table_unit", 1], ["table_unit", 2]'
  ELSE '["table_unit", 3]' END || '], "conds": []}}, "where": ' || CASE WHEN l_quantity > 45 THEN '[[false, 2, [0, [0, 10, false], null], {{"select": []}}, null]]'
  WHEN l_quantity < 3 THEN '[[false, 9, [0, [0, 7, false], null], "{{\\"x\\"}}", null]]' ELSE '[]' END || ', "groupBy": ' || CASE WHEN l_tax > 0.05 THEN '[[0, 5, false]]' ELSE '[]' END
  || ', "orderBy": ' || CASE WHEN l_discount > 0.05 THEN '["asc", [[0, [0, 3, false], null]]]' ELSE '[]' END || ', "having": ' || CASE WHEN l_tax > 0.07 THEN '[[1]]' ELSE '[]' END
  || ', "union": ' || CASE WHEN {HAS_SET} THEN '{{"select": []}}' ELSE 'null' END || ', "except": null, "intersect": null}}'"""
CLASS = (f"CASE WHEN {HAS_SET} THEN 'extra' WHEN l_linenumber = 7 OR l_quantity > 45 THEN 'hard' WHEN l_tax > 0.05 AND l_suppkey % 2 = 0 THEN 'hard' "
         "WHEN l_tax > 0.05 OR l_suppkey % 2 = 0 OR l_discount > 0.05 THEN 'medium' ELSE 'easy' END")


def _parsed(spark, sf):
    text = F.expr(PARSED.replace('\\"', '\\\\"'))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("sql")).withColumn("difficulty", X.difficulty(F.col("sql")))


@query("x1_difficulty", f"SELECT l_orderkey, l_linenumber, {CLASS} AS difficulty FROM lineitem")
def x1(spark, sf):
    return _parsed(spark, sf).select("l_orderkey", "l_linenumber", "difficulty")


@query("x2_difficulty_distribution", f"SELECT {CLASS} AS difficulty, COUNT(*) AS questions FROM lineitem GROUP BY 1")
def x2(spark, sf):
    return X.difficulty_distribution(_parsed(spark, sf))


SAMPLE = ("SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-42'), "
          "o_orderkey) AS r FROM orders) t WHERE r <= 100")


def _sample(spark, sf):
    return X.stratified_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"), "o_orderpriority", 100, "o_orderkey")


@query("x3_stratified_sample", f"SELECT o_orderkey, o_orderpriority FROM ({SAMPLE})")
def x3(spark, sf):
    return _sample(spark, sf).select("o_orderkey", "o_orderpriority")


@query("x4_shuffled_ids", f"SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY md5('42-' || o_orderkey), o_orderkey) - 1 AS BIGINT) AS id FROM ({SAMPLE})")
def x4(spark, sf):
    return X.shuffled_ids(_sample(spark, sf), "o_orderkey").select("o_orderkey", "id")


@query("x5_missing", "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def x5(spark, sf):
    return X.missing(table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), table(spark, sf, "events"), "user_id")


@query("x6_sample_stats", f"WITH s AS ({SAMPLE}) SELECT 'o_orderpriority' AS dimension, o_orderpriority AS value, COUNT(*) AS questions FROM s GROUP BY 2 UNION ALL "
       "SELECT 'o_orderstatus', o_orderstatus, COUNT(*) FROM s GROUP BY 2 UNION ALL (SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), COUNT(*) AS n FROM s GROUP BY 2 "
       "ORDER BY n DESC, CAST(o_custkey AS VARCHAR) LIMIT 5)")
def x6(spark, sf):
    return X.sample_stats(_sample(spark, sf), ["o_orderpriority", "o_orderstatus"], "o_custkey")


SCHEMA_SQL = CATALOG_SQL + """, tb AS (SELECT db_id, table_idx, 'Table: ' || table_name || chr(10) || string_agg('  - ' || column_name || ' (' || column_type || ')', chr(10) ORDER BY col_idx)
  || chr(10) AS block FROM cat_columns GROUP BY db_id, table_idx, table_name),
a AS (SELECT db_id, string_agg(block, chr(10) ORDER BY table_idx) AS blocks FROM tb GROUP BY db_id),
k AS (SELECT db_id, 'Primary Keys:' || chr(10) || string_agg('  - ' || table_name || '.' || column_name, chr(10) ORDER BY key_no) || chr(10) AS keys FROM cat_keys GROUP BY db_id),
f AS (SELECT db_id, 'Foreign Keys:' || chr(10) || string_agg('  - ' || src_table || '.' || src_column || ' -> ' || dst_table || '.' || dst_column, chr(10) ORDER BY ref_no) AS refs
  FROM cat_refs GROUP BY db_id),
schemas AS (SELECT db_id, 'Database: ' || db_id || chr(10) || chr(10) || blocks || COALESCE(chr(10) || keys, '') || COALESCE(chr(10) || refs, '') AS schema_text
  FROM a LEFT JOIN k USING (db_id) LEFT JOIN f USING (db_id))
"""


@query("x7_schema_text", SCHEMA_SQL + "SELECT db_id, schema_text FROM schemas")
def x7(spark, sf):
    return render_schema(catalogs(spark, sf))


@query("x8_prompts", SCHEMA_SQL + "SELECT conv_id, turn, db_id, 'Given the following database schema:' || chr(10) || chr(10) || schema_text || chr(10) || chr(10) || "
       "'Write a SQL query to answer this question: ' || text || chr(10) || chr(10) || 'Return only the SQL query, no explanation. Do not wrap in markdown code blocks.' AS prompt "
       "FROM conversations JOIN schemas ON db_id = 'db_' || conv_id")
def x8(spark, sf):
    q = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("db_"), "conv_id").alias("db_id"), F.col("text").alias("question"))
    return X.build_prompts(q, render_schema(catalogs(spark, sf))).select("conv_id", "turn", "db_id", "prompt")


ANSWER = ("CASE doc_id % 4 WHEN 0 THEN '```sql' || chr(10) || text || chr(10) || '```' WHEN 1 THEN ' ' || chr(10) || '```' || text || '``` ' WHEN 2 THEN chr(9) || text || chr(10) ELSE text END")


@query("x9_extract_sql", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({ANSWER}, '^\\s+|\\s+$', '', 'g'), '^```(sql)?', ''), '```$', ''), "
       "'^\\s+|\\s+$', '', 'g') AS sql FROM documents")
def x9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.extract_sql(F.expr(ANSWER)).alias("sql"))


@query("x10_resume", RESULTS_SQL + "SELECT provider, question_id, CASE WHEN match THEN 'kept' ELSE 'new' END AS origin FROM results")
def x10(spark, sf):
    every = results(spark, sf).select("question_id", "provider", "match")
    done = every.filter("match").select("question_id", "provider", F.lit("kept").alias("origin"))
    rerun = every.select("question_id", "provider", F.lit("new").alias("origin"))
    return X.merge_results(done, rerun)


@query("x10_pending", RESULTS_SQL + "SELECT question_id FROM results WHERE NOT match")
def x10b(spark, sf):
    every = results(spark, sf)
    return X.pending(every, every.filter("match")).select("question_id")


@query("x11_with_schema", RESULTS_SQL + "SELECT question_id, db_id IN (SELECT 'db_' || s_suppkey FROM supplier WHERE s_acctbal >= 0) AS has_schema FROM results")
def x11(spark, sf):
    schemas, q = log_catalog(spark, sf).tables.select("db_id").distinct(), results(spark, sf)
    yes = X.with_schema(q, schemas).select("question_id", F.lit(True).alias("has_schema"))
    return yes.union(X.without_schema(q, schemas).select("question_id", F.lit(False)))


@query("x12_limit", RESULTS_SQL + "SELECT question_id, provider FROM results ORDER BY question_id LIMIT 100")
def x12(spark, sf):
    return results(spark, sf).select("question_id", "provider").orderBy("question_id").limit(100)


@query("x13_failures", RESULTS_SQL + "SELECT question_id, CASE WHEN error IS NULL THEN 'SELECT ' || question_id ELSE '' END AS predicted_sql, "
       "error IS NULL AND match AS match, COALESCE('LLM error: ' || error, '') AS error FROM results")
def x13(spark, sf):
    answers = results(spark, sf).withColumn("predicted_sql", F.concat(F.lit("SELECT "), "question_id"))
    return X.failure_rows(answers).select("question_id", "predicted_sql", "match", F.coalesce("error", F.lit("")).alias("error"))


@query("x14_leaderboard", RESULTS_SQL + "SELECT provider, COUNT(*) AS total, COUNT(CASE WHEN match THEN 1 END) AS correct, COUNT(error) AS errors, "
       "COUNT(CASE WHEN match THEN 1 END) / COUNT(*) AS accuracy FROM results GROUP BY provider ORDER BY accuracy DESC, provider")
def x14(spark, sf):
    return X.leaderboard(results(spark, sf))


def _rounded(df):
    """Engines interpolate a percentile in another order of operations: the last bit may differ."""
    return df.withColumns({n: F.round(n, 6) for n in ("median", "p95")})


@query("x15_latency", RESULTS_SQL + f"SELECT provider, COUNT(latency_ms) AS n, {xavg('latency_ms')} AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS median, "
       "round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM results GROUP BY provider")
def x15(spark, sf):
    return _rounded(X.latency_stats(results(spark, sf), scale=2))


@query("x16_error_attribution", """WITH f AS (SELECT event_id, event_id % 3 = 0 AS m, CASE WHEN value < 5 THEN 'bad JOIN here' WHEN value < 20 THEN 'parse' ELSE '' END AS e FROM events WHERE user_id > 10),
g AS (SELECT event_id, event_id % 2 = 0 AS m, CASE WHEN value < 15 THEN 'parse' ELSE '' END AS e FROM events WHERE user_id < 140)
SELECT event_id AS question_id, CASE WHEN COALESCE(f.m, false) THEN 'none' WHEN contains(lower(COALESCE(f.e, '')), 'join') THEN 'missing join' WHEN COALESCE(g.m, false) THEN 'column selection'
WHEN COALESCE(f.e, '') <> '' AND COALESCE(g.e, '') <> '' THEN 'syntax' ELSE 'logic' END AS cause FROM f FULL JOIN g USING (event_id)""")
def x16(spark, sf):
    events = table(spark, sf, "events")

    def run_of(n, error, keep):
        return events.filter(keep).select(F.col("event_id").alias("question_id"), (F.col("event_id") % n == 0).alias("match"), error.alias("error"))

    value = F.col("value")
    full = run_of(3, F.when(value < 5, "bad JOIN here").when(value < 20, "parse"), "user_id > 10")
    return X.attribute_errors(full, run_of(2, F.when(value < 15, "parse"), "user_id < 140"))


Z = "1.96e0"
RATE = "(c / n)"


@query("x17_accuracy_interval", RESULTS_SQL + f""", k AS (SELECT provider, CAST(COUNT(*) AS DOUBLE) AS n, COUNT(CASE WHEN match THEN 1 END) AS c FROM results GROUP BY 1)
SELECT provider, CAST(n AS BIGINT) AS total, c AS correct, {RATE} AS accuracy,
  ({RATE} + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - sqrt({RATE} * (1 - {RATE}) / n + {Z} * {Z} / (4 * n * n)) * {Z} / (1 + {Z} * {Z} / n) AS low,
  ({RATE} + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + sqrt({RATE} * (1 - {RATE}) / n + {Z} * {Z} / (4 * n * n)) * {Z} / (1 + {Z} * {Z} / n) AS high FROM k""")
def x17(spark, sf):
    return X.accuracy_by(results(spark, sf), ["provider"])


@query("x18_stream_metrics", RESULTS_SQL + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, provider, COUNT(*) AS total, COUNT(CASE WHEN match THEN 1 END) AS correct, "
       "COUNT(error) AS errors FROM results GROUP BY 1, 2")
def x18(spark, sf):
    """The same results delivered twice, as a stream."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = staging_path(spark, "arrivals")
    rows = results(spark, sf).select("question_id", "provider", "match", "error", F.col("ts").cast("timestamp").alias("event_time"))
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(S.RESULT_SCHEMA).parquet(path)
    state = S.run_available(spark, S.stream_metrics(stream))
    return state.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "provider", "total", "correct", "errors")


@query("p1_token_stats", "SELECT lang, MIN(n_chars) AS min, round(quantile_cont(n_chars, 0.5), 6) AS median, AVG(n_chars) AS mean, MAX(n_chars) AS max, round(quantile_cont(n_chars, 0.95), 6) AS p95 "
       "FROM documents GROUP BY lang")
def p1(spark, sf):
    return _rounded(P.token_stats(table(spark, sf, "documents"), ["lang"], "n_chars"))


@query("p2_size_buckets", "SELECT bucket, n, 100.0e0 * n / (SELECT COUNT(*) FROM documents) AS percent FROM (SELECT CASE WHEN n_chars < 100 THEN '< 100' WHEN n_chars < 300 THEN '100-300' "
       "WHEN n_chars < 500 THEN '300-500' ELSE '500+' END AS bucket, COUNT(*) AS n FROM documents GROUP BY 1) t")
def p2(spark, sf):
    return P.size_buckets(table(spark, sf, "documents"), "n_chars")


MONEY = "CAST(({i} * p.i + {o} * p.o) * 0.000001 AS DOUBLE)"


@query("p3_run_cost", USAGE_SQL + f"""SELECT model, q AS questions, {MONEY.format(i='si', o='0')} AS input_cost, {MONEY.format(i='0', o='so')} AS output_cost, {MONEY.format(i='si', o='so')} AS total_cost,
  {MONEY.format(i='si', o='so')} / q AS per_question FROM prices p, (SELECT SUM(input_tokens) AS si, SUM(output_tokens) AS so, COUNT(DISTINCT question_id) AS q FROM usage) u""")
def p3(spark, sf):
    return _money(P.run_cost(usage(spark, sf), prices(spark)))


def _money(df):
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields])


STEP_SUM = "(SELECT step, SUM(input_tokens) AS si, SUM(output_tokens) AS so FROM usage GROUP BY step) u"
SHARE = "(CASE WHEN step = 'correct' THEN 0.3 ELSE 1 END)"


@query("p4_stepwise_cost", USAGE_SQL + f"SELECT model, COALESCE(step, '(all)') AS step, CAST(SUM((si * p.i + so * p.o) * 0.000001 * {SHARE}) AS DOUBLE) AS cost FROM prices p, {STEP_SUM} "
       "GROUP BY GROUPING SETS ((model, step), (model))")
def p4(spark, sf):
    return _money(P.stepwise_cost(usage(spark, sf), prices(spark), {"correct": 0.3}).withColumn("step", F.coalesce("step", F.lit("(all)"))))


ASSIGNED = [(f"{a}+{b}+{c}", step, m) for a, b, c in (("amber", "amber", "amber"), ("cedar", "birch", "cedar"), ("ember", "birch", "ember"), ("dune", "fjord", "cedar"))
            for step, m in zip(STEPS, (a, b, c))]


@query("p5_hybrid_cost", USAGE_SQL + f"SELECT configuration, CAST(SUM((si * p.i + so * p.o) * 0.000001) AS DOUBLE) AS total_cost FROM (VALUES "
       f"{', '.join(str(a) for a in ASSIGNED)}) a(configuration, step, model) JOIN {STEP_SUM} USING (step) JOIN prices p USING (model) GROUP BY configuration")
def p5(spark, sf):
    return _money(P.hybrid_cost(usage(spark, sf), spark.createDataFrame(ASSIGNED, "configuration string, step string, model string"), prices(spark)))


@query("p6_budget", "WITH t AS (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS x FROM orders) "
       "SELECT o_orderpriority AS phase, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS cost FROM orders GROUP BY 1 "
       "UNION ALL SELECT 'buffer', round(x * 0.2e0, 2) FROM t UNION ALL SELECT 'total', x + round(x * 0.2e0, 2) FROM t")
def p6(spark, sf):
    return P.budget(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_totalprice").alias("cost")))


@query("p7_projection", USAGE_SQL + "SELECT model, round(CAST((SUM(input_tokens) * p.i + SUM(output_tokens) * p.o) * 0.000001 AS DOUBLE) * 8034 / 1000, 2) AS projected "
       "FROM usage JOIN prices p USING (model) GROUP BY model, p.i, p.o")
def p7(spark, sf):
    own = P.apply_discounts(usage(spark, sf), prices(spark), ["model"], cached=0, batch=0)
    return P.project_cost(own.select("model", F.col("list_cost").cast("double").alias("cost")), 1000, 8034).select("model", "projected")


@query("p8_discounts", USAGE_SQL + "SELECT model, CAST(SUM((input_tokens * p.i + output_tokens * p.o) * 0.000001) AS DOUBLE) AS list_cost, CAST(SUM((input_tokens * "
       "p.i * (CASE WHEN cached THEN 0.1 ELSE 1.0 END) * (CASE WHEN batch THEN 0.5 ELSE 1.0 END) + output_tokens * p.o * (CASE WHEN batch THEN 0.5 ELSE 1.0 END) "
       ") * 0.000001) AS DOUBLE) AS paid_cost FROM usage JOIN prices p USING (model) GROUP BY model")
def p8(spark, sf):
    return _money(P.apply_discounts(usage(spark, sf), prices(spark), ["model"]))


@query("p9_pareto", "WITH b AS (SELECT l_extendedprice AS c, MAX(l_quantity) AS g FROM lineitem GROUP BY 1), "
       "f AS (SELECT c, g, MAX(g) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) "
       "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem JOIN f ON l_extendedprice = c AND l_quantity = g WHERE before IS NULL OR g > before")
def p9(spark, sf):
    return P.pareto(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


@query("p10_early_stop", RESULTS_SQL + "SELECT provider, COUNT(*) AS seen, COUNT(CASE WHEN match THEN 1 END) AS correct, COUNT(CASE WHEN match THEN 1 END) / COUNT(*) AS accuracy, "
       "COUNT(*) >= 200 AND COUNT(CASE WHEN match THEN 1 END) / COUNT(*) < 0.34 AS stop FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY provider ORDER BY question_id) AS r FROM results) "
       "WHERE r <= 200 GROUP BY provider")
def p10(spark, sf):
    return P.early_stop(results(spark, sf), ["provider"], ["question_id"], 200, 0.34)
