"""Result comparison: do two DataFrames hold the same rows, whatever the order of rows
and columns and whatever the columns are called?

Columns are matched by fingerprints that one pass over each side computes without a
shuffle. A verdict is never left to a hash: a match is confirmed by counting rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.functions.normalize import normalize, normalize_frame
from semaspark.plans.model import quoted
from semaspark.session import cut_lineage

GOLD, PRED = "gold", "pred"


def _groups(dtype: T.DataType) -> bool:
    """Whether Spark can group by the type."""
    if isinstance(dtype, T.StructType):
        return all(_groups(f.dataType) for f in dtype.fields)
    return _groups(dtype.elementType) if isinstance(dtype, T.ArrayType) else not isinstance(dtype, (T.MapType, T.VariantType))


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[bool]]:
    """Both sides with columns c0, c1, … of one type each, and which of them are as they were. Columns of unlike types, and
    those that hold maps, become canonical text: nothing is cast, so no value can stop the job or be changed."""
    names = [f"c{i}" for i in range(len(a.columns))]
    left, right = a.toDF(*names), b.toDF(*names)
    kept = [f.dataType.simpleString() == g.dataType.simpleString() and _groups(f.dataType) for f, g in zip(left.schema.fields, right.schema.fields)]

    def side(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name) if plain else normalize(F.col(f.name), f.dataType).alias(f.name) for f, plain in zip(df.schema.fields, kept)])

    return side(left), side(right), kept


def _signed(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right, _ = aligned(a, b)
    return left.withColumn("__n", F.lit(1)).union(right.withColumn("__n", F.lit(-1)))


def bag_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows with the same multiplicities.

    A fingerprint of each side, one scan without a shuffle, settles most differences. Equal
    fingerprints are confirmed by counting: one shuffle, after map-side combining, so rows
    repeated any number of times travel once per task. Columns of unlike types are compared by canonical text (1, 1.0 and
    '1' are one value), maps by their entries in any order."""
    if len(a.columns) != len(b.columns):
        return False
    signed = _signed(a, b)
    keys = [c for c in signed.columns if c != "__n"]
    sides = signed.groupBy("__n").agg(F.count("*").alias("rows"), fingerprint(*[F.col(c) for c in keys]).alias("fp")).collect()
    if len({(r["rows"], tuple(r["fp"])) for r in sides}) > 1 or len(sides) == 1:
        return False
    return _cancels(signed)


def _cancels(signed: DataFrame) -> bool:
    keys = [c for c in signed.columns if c != "__n"]
    return signed.groupBy(*keys).agg(F.sum("__n").alias("__n")).filter("__n <> 0").isEmpty()


def with_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows 0, 1, 2, … in their present order, without gathering them in one task.

    The ordered rows are written to the shared folder first, so the numbers cannot change
    if a task runs again. The table of offsets has one row per partition: that bounds both
    the window over it and its broadcast."""
    rows = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (within + F.col("__before")).alias(name))


def ordered_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows in the same order: a bag comparison of numbered rows."""
    return len(a.columns) == len(b.columns) and bag_equal(with_positions(a), with_positions(b))


def order_is_ambiguous(df: DataFrame, keys: Sequence[str]) -> bool:
    """True if the sort keys tie, so that two correct runs may order rows differently."""
    return not df.groupBy(*keys).count().filter("count > 1").isEmpty()


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def fingerprint(*cols: Column) -> Column:
    """An order-independent fingerprint of a bag of values. Shifted sums stay within a long
    for 2^43 rows and see multiplicities; the exclusive-or sees every bit."""
    h, g = hash_pair(*cols)
    return F.struct(F.sum(F.shiftright(h, 44)).alias("s"), F.bit_xor(h).alias("x"),
                    F.sum(F.shiftright(g, 44)).alias("t"))


def _tagged(col: Column) -> Column:
    return F.coalesce(col, F.lit("\x00"))


def column_fingerprints(normalized: DataFrame) -> DataFrame:
    """One row per column of a normalised frame: ``col_no, n_rows, fp``. One pass, no shuffle of rows."""
    cols = normalized.columns
    one = normalized.agg(F.count("*").alias("n_rows"), *[fingerprint(_tagged(F.col(c))).alias(f"f{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(f"f{i}").alias("fp")) for i in range(len(cols))])
    return one.select("n_rows", F.explode(each).alias("e")).select("e.col_no", "n_rows", "e.fp")


def column_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """``left_col, right_col`` for columns that hold the same bag of values."""
    left = column_fingerprints(normalize_frame(a)).select(F.col("col_no").alias("left_col"), "fp")
    right = column_fingerprints(normalize_frame(b)).select(F.col("col_no").alias("right_col"), "fp")
    return left.join(right, "fp").select("left_col", "right_col")


def permute(df: DataFrame, order: Sequence[int]) -> DataFrame:
    names = df.columns
    return df.select(*[F.col(f"`{names[i]}`") for i in order])


def _profile(a: DataFrame, b: DataFrame):
    """Row counts and sorted column fingerprints of both sides, from one job; the answer has
    one row per column."""
    sides = column_fingerprints(a).withColumn("side", F.lit(0)).union(column_fingerprints(b).withColumn("side", F.lit(1)))
    rows = sides.collect()
    out = []
    for side in (0, 1):
        mine = [r for r in rows if r["side"] == side]
        fps = sorted((tuple(-1 if v is None else v for v in r["fp"]), r["col_no"]) for r in mine)
        out.append((mine[0]["n_rows"], fps))
    return out


def quick_reject(a: DataFrame, b: DataFrame) -> bool:
    """True if no column mapping can make the two results equal."""
    if len(a.columns) != len(b.columns):
        return True
    (_, left), (_, right) = _profile(normalize_frame(a), normalize_frame(b))
    return [fp for fp, _ in left] != [fp for fp, _ in right]


def column_mapping(a: DataFrame, b: DataFrame) -> list[int] | None:
    """The column of ``b`` for each column of ``a`` if fingerprints leave one choice."""
    (_, left), (_, right) = _profile(normalize_frame(a), normalize_frame(b))
    fps = [fp for fp, _ in left]
    if fps != [fp for fp, _ in right] or len(set(fps)) != len(fps):
        return None
    return [j for _, j in sorted((i, right[slot][1]) for slot, (_, i) in enumerate(left))]


def result_equal(a: DataFrame, b: DataFrame, ordered: bool = False, digits: int | None = None, stage: bool = False) -> bool:
    """Whether two results are the same answer.

    Cheap tests come first: column counts from the schema, then row counts and column
    fingerprints from one scan. Two empty results match whatever their columns.
    ``stage`` writes both sides to the shared folder once, for inputs that are costly or
    not repeatable.
    """
    left, right = normalize_frame(a, digits), normalize_frame(b, digits)
    if ordered:
        left, right = with_positions(left), with_positions(right)
    elif stage:
        left, right = cut_lineage(left), cut_lineage(right)
    plain = [df.drop("pos") if ordered else df for df in (left, right)]
    (n_left, fps_left), (n_right, fps_right) = _profile(*plain)
    if n_left == 0 and n_right == 0:
        return True
    if n_left != n_right or len(a.columns) != len(b.columns):
        return False
    fps = [fp for fp, _ in fps_left]
    if fps != [fp for fp, _ in fps_right]:
        return False
    extra = ["pos"] if ordered else []
    first = left.select(*[f"c{i}" for _, i in fps_left], *extra)
    second = right.select(*[f"c{j}" for _, j in fps_right], *extra)
    if _cancels(_signed(first, second)):
        return True
    if len(set(fps)) == len(fps):
        return False
    return _search_one(first, second, fps, ordered)


def _search_one(first: DataFrame, second: DataFrame, fps: list, ordered: bool) -> bool:
    """Columns with equal value bags, differently paired: leave it to colours and the exact search."""
    from semaspark.operators.batch_compare import resolve

    spark = first.sparkSession
    k = len(fps)
    order = sorted(range(k), key=lambda i: (fps.count(fps[i]), fps[i]))
    classes = [fps.index(fps[i]) for i in order]

    def rows(df: DataFrame, side: str) -> DataFrame:
        vals = F.array(*[_tagged(F.col(df.columns[i])) for i in order])
        return df.select(F.lit(0).alias("question_id"), F.lit(side).alias("side"),
                         (F.col("pos") if ordered else F.lit(None).cast("bigint")).alias("pos"), vals.alias("vals"))

    start = spark.createDataFrame([(0, classes)], "question_id int, classes array<int>")
    return not resolve(rows(first, GOLD).union(rows(second, PRED)), start).isEmpty()


def diff_frames(a: DataFrame, b: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """The rows in which two tables differ.

    Without a key: each differing row with its count on both sides. With a key: one row per
    differing key, its ``status`` (left_only, right_only, changed, duplicate_key) and the
    names of the changed columns. Either way rows are grouped, never paired."""
    names = a.columns
    if len(names) != len(b.columns):
        raise ValueError(f"{len(names)} columns on the left, {len(b.columns)} on the right")
    left, right, kept = aligned(a, b if key is None else b.select(*[F.col(quoted(c)) for c in names]))
    # A canonical text loses its tag where it is shown.
    shown = [F.col(f"c{i}") if plain else F.regexp_replace(f"c{i}", r"\A[a-z]:", "") for i, plain in enumerate(kept)]
    if key is None:
        both = left.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).union(right.withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1)))
        counted = both.groupBy(*left.columns).agg(F.sum("__l").alias("n_left"), F.sum("__r").alias("n_right")).filter("n_left <> n_right")
        return counted.select(*[c.alias(n) for c, n in zip(shown, names)], "n_left", "n_right")
    at = {n: f"c{i}" for i, n in enumerate(names)}
    shown_keys = [shown[names.index(k)].alias(k) for k in key]
    left, right, rest = left.withColumnsRenamed({at[c]: c for c in names}), right.withColumnsRenamed({at[c]: c for c in names}), [c for c in names if c not in key]

    def side(df: DataFrame, tag: str) -> DataFrame:
        packed = F.struct(*[F.col(quoted(c)) for c in rest])
        other = F.lit(None).cast(df.select(packed.alias("s")).schema["s"].dataType)
        mine, theirs = (packed, other) if tag == "l" else (other, packed)
        return df.select(*[F.col(quoted(k)) for k in key], mine.alias("l"), theirs.alias("r"), F.lit(int(tag == "l")).alias("nl"), F.lit(int(tag == "r")).alias("nr"))

    both = side(left, "l").union(side(right, "r"))
    grouped = both.groupBy(*[F.col(quoted(k)) for k in key]).agg(F.max("l").alias("l"), F.max("r").alias("r"), F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    changed = F.concat_ws(",", *[F.when(~F.col("l").getField(c).eqNullSafe(F.col("r").getField(c)), F.lit(c)) for c in rest])
    status = (F.when((F.col("nl") > 1) | (F.col("nr") > 1), "duplicate_key").when(F.col("nr") == 0, "left_only")
              .when(F.col("nl") == 0, "right_only").when(changed != "", "changed"))
    grouped = grouped.withColumns({"status": status, "changed": F.when(status == "changed", changed).otherwise("")}).filter("status is not null")
    return grouped.withColumnsRenamed({k: at[k] for k in key}).select(*shown_keys, "status", "changed")


def metrics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``total, correct, errors, accuracy``; accuracy is 0.0 when there is nothing to count."""
    correct = F.count_if(F.coalesce(F.col("match"), F.lit(False)))
    counted = results.groupBy(*by).agg(
        F.count("*").alias("total"), correct.alias("correct"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"))
    rate = F.coalesce(F.try_divide(F.col("correct"), F.col("total")), F.lit(0.0))
    return counted.withColumn("accuracy", rate)


def order_matters(sql: Column, strict: bool = False) -> Column:
    """Whether the reference answer is ordered. The default is the plain containment test;
    ``strict`` looks only at the outer query: not in literals, not in parentheses, any spacing."""
    text = F.lower(sql)
    if not strict:
        return text.contains("order by")
    # Literals and quoted names first: they may hold what looks like a comment, and comments what looks like a quote.
    bare = F.regexp_replace(text, r"""('(?:[^']|'')*+'|"[^"]*+")|--[^\n]*+|/\*[\s\S]*?\*/""", " ")
    parts = F.regexp_extract_all(bare, F.lit(r"[()]|[^()]+"), 0)

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "(", 1).when(part == ")", -1).otherwise(0)
        keep = (acc["depth"] == 0) & ~part.isin("(", ")")
        return F.struct(depth.alias("depth"), F.when(keep, F.concat(acc["text"], part)).otherwise(acc["text"]).alias("text"))

    outer = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step)["text"]
    return outer.rlike(r"\border\s+by\b")


def query_only(spark: SparkSession, sql: str) -> DataFrame:
    """The answer of a query. What is no query, such as DROP or INSERT, fails before it runs: it cannot stand in a subquery."""
    text = sql.strip().rstrip(";")
    spark.sql(f"SELECT * FROM (\n{text}\n) AS answer")
    return spark.sql(text)


def execute(spark: SparkSession, sql: str) -> tuple[DataFrame | None, str | None]:
    """The normalised answer, staged once in the order it came, or the error text."""
    try:
        return cut_lineage(normalize_frame(query_only(spark, sql))), None
    except PySparkException as error:
        return None, str(error).strip()
    except Exception as error:  # runtime failures of a task surface as JVM errors
        return None, str(error).strip()


def order_flag(spark: SparkSession, gold: str, strict: bool) -> bool:
    return spark.range(1).select(order_matters(F.lit(gold), strict).alias("o")).head()["o"]


def compare_queries(spark: SparkSession, predicted: str, gold: str, strict_order: bool = False) -> DataFrame:
    """One row ``match, error``. An error of the predicted text is reported before one of the gold text."""
    answer, error = execute(spark, predicted)
    if error:
        return _verdict(spark, False, f"Predicted SQL error: {error}")
    expected, error = execute(spark, gold)
    if error:
        return _verdict(spark, False, f"Gold SQL error: {error}")
    return _verdict(spark, result_equal(expected, answer, order_flag(spark, gold, strict_order)), None)


def _verdict(spark: SparkSession, match: bool, error: str | None) -> DataFrame:
    return spark.createDataFrame([(match, error)], "match boolean, error string")


def broken(sql: Column, is_empty: Column) -> Column:
    """Query text whose answer must differ: no rows where there were some, a row where there were none."""
    has_limit = sql.rlike(r"(?i)\blimit\s+\d+")
    none = F.when(has_limit, F.regexp_replace(sql, r"(?i)\blimit\s+\d+", "LIMIT 0")).otherwise(F.concat(sql, F.lit(" LIMIT 0")))
    return F.when(is_empty, F.lit("SELECT 'forced' AS c1")).otherwise(none)
