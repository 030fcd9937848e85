"""Line dedup over windows of three consecutive lines.

Lines are cut at line feeds; lines without a word are not counted into windows and always stay. Three
consecutive counted lines are a window. Windows are compared by two 64-bit hashes of their trimmed lines, over
all documents; of equal windows the first stays, by (doc_id, place), and each later one covers its three lines.
Covered lines go, however many windows cover them. A run of one line repeated keeps its first line.

A document of fewer than three counted lines has no window and stays whole. Null text stays null. A null
doc_id comes last in the order. Rows equal in doc_id and text count as one document and get the same result.
Empty tables give no rows; other columns are kept by ``drop_repeats`` and not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import free_name, stage, table

SALTS = 16
TRIM = "\t\n\x0b\f\r "


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counted(text: Column) -> Column:
    """Trimmed lines that have a word."""
    return F.filter(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(TRIM))), lambda x: x != "")


def covered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_key, text_key and the sorted places of the counted lines that go; only documents that lose lines."""
    lines = _counted(F.col(text))
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b")))
    rows = docs.select(*keys(doc_id, text), hashed.alias("line")).where(F.size("line") >= 3)
    each = rows.select("doc_key", "text_key", "line", F.explode(F.sequence(F.lit(0), F.size("line") - 3)).alias("pos"))
    window = [F.xxhash64(*(F.get("line", F.col("pos") + j)[h] for j in range(3))).alias(h) for h in ("a", "b")]
    each = stage(each.select("doc_key", "text_key", "pos", *window), "windows")
    at = F.struct("doc_key", "text_key", "pos")
    # Rows that are equal in key and place are one occurrence: a window is repeated if its least and its
    # greatest place differ. Both are summed per task first, so a hot window sends one row a task.
    first = each.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select("a", "b", "first")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = each.withColumn("salt", F.pmod(F.xxhash64("doc_key", "text_key", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"]).where(at != F.col("first"))
    lost = later.select("doc_key", "text_key", "pos").distinct().groupBy("doc_key", "text_key").agg(F.collect_list("pos").alias("p"))
    return lost.select("doc_key", "text_key", F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: F.array(x, x + 1, x + 2))))).alias("gone"))


def keys(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id), F.lit(2**63 - 1)).cast("long").alias("doc_key"), F.xxhash64(F.col(text)).alias("text_key")]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often lambdas inside look at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _left_over(text: Column, gone: Column) -> Column:
    """A struct of the text that stays, its lines before and how many went. A text that loses none is not taken apart;
    in others counted lines are found by place and lost ones by hash, so long texts take time in proportion."""
    def places(lines: Column) -> Column:
        return F.filter(_numbers(lines), lambda i: F.btrim(F.get(lines, i), F.lit(TRIM)) != "")

    def stay(lines: Column) -> Column:
        return _once(places(lines), lambda at: F.array_except(_numbers(lines), F.transform(gone, lambda g: F.get(at, g))))

    kept = _once(_lines(text), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    return F.struct(F.when(gone.isNull(), text).otherwise(kept).alias("text"),
                    F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
                    F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"))


def _numbers(lines: Column) -> Column:
    return F.sequence(F.lit(0), F.size(lines) - 1)


def _joined(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with one more struct: the text that stays, its lines before and how many went."""
    lost, names = covered(docs, doc_id, text), [free_name(docs, n) for n in ("doc_key", "text_key", "gone", "left_over")]
    lost = lost.select(F.col("doc_key").alias("k1"), F.col("text_key").alias("k2"), F.col("gone").alias("k3")).toDF(*names[:3])
    keyed = docs.withColumns(dict(zip(names[:2], keys(doc_id, text))))
    return keyed.join(lost, names[:2], "left").withColumn(names[3], _left_over(F.col(text), F.col(names[2]))).drop(*names[:3]), names[3]


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lines before, lines removed and the text that stays, one row per row."""
    rows, new = _joined(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    return rows.select("doc_id", f"{new}.n_lines", f"{new}.n_removed", f"{new}.text")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, with the text that stays; a document that loses its last word goes with it."""
    rows, new = _joined(docs, doc_id, text)
    stays = (F.col(f"{new}.n_removed") == 0) | F.col(f"{new}.text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(stays).select(*(F.col(f"{new}.text").alias(c) if c == text else F.col(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, i AS place, parts[i] AS line, trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM raw, unnest(range(1, len(parts) + 1)) AS u(i)),
counted AS (SELECT doc_id, place, cut, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos FROM lines WHERE cut <> ''),
win AS (SELECT doc_id, pos, cut AS a, lead(cut, 1) OVER w AS b, lead(cut, 2) OVER w AS c FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM win WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, range(3) AS r(j) WHERE n > 1),
lost AS (SELECT c.doc_id, c.place FROM counted c JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE x.place IS NULL) AS text, count(x.place) AS n_removed
  FROM lines l LEFT JOIN lost x ON l.doc_id = x.doc_id AND l.place = x.place GROUP BY l.doc_id)
SELECT r.doc_id, CAST(coalesce(len(r.parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text
FROM raw r LEFT JOIN left_over o ON r.doc_id = o.doc_id
"""
