"""Comparison of many result pairs in one job.

Results are held long: a header per result and its cells. Questions differ in size, and
one may hold a third of all cells, so every step groups by finer keys than the question,
and the one join on the question alone is salted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.functions.normalize import normalize
from semaspark.operators.compare import GOLD, PRED, _tagged, fingerprint, hash_pair
from semaspark.session import BROADCAST_ROWS, cut_lineage, sized, stage_rows

SALTS = 32
PIECES = 3


def _salted_join(rows: DataFrame, per_question: DataFrame, spread: Column, pieces: int = 1) -> DataFrame:
    """Join one row per question to the many rows of it. A short list of questions is sent to the
    rows; for a long one ``spread`` divides a hot question. Rows that are staged can be read again for each of ``pieces`` lists, which
    takes no disk, as a shuffle of them would."""
    keys = ["question_id"]
    per_question, small = sized(per_question, BROADCAST_ROWS)
    if small:
        return rows.join(per_question, keys)
    n = -(-per_question.count() // BROADCAST_ROWS)
    if n <= pieces and rows.schema["question_id"].dataType == per_question.schema["question_id"].dataType:
        of = F.pmod(F.xxhash64("question_id"), F.lit(n))
        each = [rows.filter(of == i).join(F.broadcast(per_question.filter(of == i)), keys) for i in range(n)]
        return reduce(DataFrame.unionByName, each)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    # Sorted, because the size that Spark estimates knows nothing of the salts: it would broadcast them all.
    return left.join(per_question.withColumn("__salt", salts).hint("merge"), [*keys, "__salt"]).drop("__salt")


def early_verdicts(headers: DataFrame) -> DataFrame:
    """One row per question; ``match`` is NULL where the rows must be looked at.

    ``headers``: question_id, side, n_rows, n_cols, error, ordered."""

    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side}_{name}")

    wide = headers.groupBy("question_id").agg(
        *[of(s, n) for s in (GOLD, PRED) for n in ("n_rows", "n_cols", "error")], F.bool_or("ordered").alias("ordered"))
    error = (F.when(F.col("pred_error").isNotNull(), F.concat(F.lit("Predicted SQL error: "), "pred_error"))
             .when(F.col("gold_error").isNotNull(), F.concat(F.lit("Gold SQL error: "), "gold_error"))
             .when(F.col("pred_n_rows").isNull() | F.col("gold_n_rows").isNull(), F.lit("result missing")))
    match = (F.when(error.isNotNull(), False)
             .when((F.col("gold_n_rows") == 0) & (F.col("pred_n_rows") == 0), True)
             .when(F.col("gold_n_rows") != F.col("pred_n_rows"), False)
             .when(F.col("gold_n_cols") != F.col("pred_n_cols"), False))
    return wide.select("question_id", F.coalesce("ordered", F.lit(False)).alias("ordered"), match.alias("match"), error.alias("error"))


def rows_of_cells(cells: DataFrame) -> DataFrame:
    """Cells (question_id, side, row_no, col_no, value) as one normalised array per row. A group
    is one row, so its size is the column count."""
    value = normalize(F.col("value").cast("string"), T.StringType())
    return (cells.groupBy("question_id", "side", F.col("row_no").alias("pos"))
            .agg(F.array_sort(F.collect_list(F.struct("col_no", _tagged(value).alias("v")))).alias("cs"))
            .select("question_id", "side", "pos", F.transform("cs", lambda c: c["v"]).alias("vals")))


def compare_rows(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdicts ``question_id, match, error`` for rows (question_id, side, pos, vals)."""
    early = early_verdicts(headers)
    # The narrow answers are used three times below and cost a scan each: stage them once. Positions that do not count are left out.
    open_questions = early.filter("match is null").select("question_id", "ordered")
    rows = _salted_join(rows.select("question_id", "side", "pos", "vals"), open_questions, F.xxhash64("side", "pos"))
    rows = stage_rows(rows.withColumn("pos", F.when(F.col("ordered"), F.col("pos"))), "answers")
    slots = _column_slots(rows)
    comparable = cut_lineage(slots.filter("comparable"))
    # Rows of a guessed order of columns are dealt by value only where fingerprints of the whole rows agree.
    guessed = comparable.filter("ambiguous")
    unlike = cut_lineage(_unlike(_placed(rows, guessed))) if not guessed.isEmpty() else guessed.select("question_id")
    equal = equal_bags(_placed(rows, comparable.join(unlike, "question_id", "left_anti")))
    done = comparable.select("question_id", "classes", "n_single", "ambiguous").join(equal, "question_id", "left").withColumn("equal", F.coalesce("equal", F.lit(False)))
    done = cut_lineage(done)
    unclear = done.filter("ambiguous and not equal").select("question_id", "classes")
    verdict = done.select("question_id", "equal")
    if not unclear.isEmpty():
        # No second copy of the rows: they are staged, and each use below meets them in one join.
        left = guessed.select("question_id", "gold_cols", "pred_cols").join(unclear, "question_id")
        found = _resolved(_placed(rows, left), unclear, lambda slots: _placed(rows, _through(left, slots))).withColumn("found", F.lit(True))
        verdict = verdict.join(found, "question_id", "left").select(
            "question_id", (F.col("equal") | F.coalesce("found", F.lit(False))).alias("equal"))
    return early.join(verdict, "question_id", "left").select(
        "question_id", F.coalesce("match", "equal", F.lit(False)).alias("match"), "error")


def _through(first: DataFrame, slots: DataFrame) -> DataFrame:
    """Slots over the columns that are in the order of ``first``, as slots over the columns they were taken from."""
    def taken(name: str) -> Column:
        return F.transform(F.col(f"s.{name}"), lambda i: F.get(F.col(f"f.{name}"), i)).alias(name)

    return first.alias("f").join(slots.alias("s"), "question_id").select("question_id", taken("gold_cols"), taken("pred_cols"))


def _placed(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Staged rows of the questions of ``slots`` with their columns in slot order."""
    return _salted_join(rows, slots.select("question_id", "gold_cols", "pred_cols"), F.xxhash64("side", "pos", "vals"), PIECES).select(
        "question_id", "side", F.when(F.col("ordered"), F.col("pos")).alias("pos"),
        F.transform(F.when(F.col("side") == GOLD, F.col("gold_cols")).otherwise(F.col("pred_cols")),
                    lambda i: F.element_at("vals", i + 1)).alias("vals"))


def _unlike(placed: DataFrame) -> DataFrame:
    """``question_id`` where the fingerprints of all rows of the two sides differ, so that their bags differ."""
    one = [F.sum(F.when(F.col("side") == GOLD, x).otherwise(-x)) for x in (F.shiftright(h, 44) for h in hash_pair(F.col("pos"), F.col("vals")))]
    return placed.groupBy("question_id").agg(((one[0] != 0) | (one[1] != 0)).alias("differ")).filter("differ").select("question_id")


def _column_slots(rows: DataFrame) -> DataFrame:
    """Per question, the columns of each side in an order that fingerprints agree on: columns
    whose bag of values is unique come first, then groups of columns with equal bags."""
    cells = rows.select("question_id", "side", F.posexplode("vals").alias("col_no", "v"))
    return _slots(cells.groupBy("question_id", "side", "col_no").agg(fingerprint(F.col("v")).alias("fp")))


def _slots(prints: DataFrame) -> DataFrame:
    """Slots for columns (question_id, side, col_no, fp): columns may be paired if they have the same ``fp``."""
    sides = prints.groupBy("question_id", "side").agg(F.collect_list(F.struct("fp", "col_no")).alias("cs"))
    ranked = sides.select("question_id", "side", F.array_sort(F.transform("cs", lambda c: F.struct(
        F.size(F.filter("cs", lambda d: d["fp"] == c["fp"])).alias("copies"), c["fp"].alias("fp"), c["col_no"].alias("col_no")))).alias("cs"))

    def one(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("cs")))

    wide = ranked.groupBy("question_id").agg(one(GOLD).alias("g"), one(PRED).alias("p"))
    prints_of = lambda name: F.transform(name, lambda c: c["fp"])
    return wide.select(
        "question_id", F.coalesce(prints_of("g") == prints_of("p"), F.lit(False)).alias("comparable"),
        F.transform("g", lambda c: c["col_no"]).alias("gold_cols"), F.transform("p", lambda c: c["col_no"]).alias("pred_cols"),
        F.transform("g", lambda c: F.array_position(prints_of("g"), c["fp"]).cast("int")).alias("classes"),
        F.size(F.filter("g", lambda c: c["copies"] == 1)).alias("n_single"),
        F.exists("g", lambda c: c["copies"] > 1).alias("ambiguous"))


def equal_bags(placed: DataFrame) -> DataFrame:
    """``question_id, equal``: rows counted +1 for gold and -1 for predicted all cancel out."""
    sign = F.when(F.col("side") == GOLD, 1).otherwise(-1)
    balance = placed.groupBy("question_id", "pos", "vals").agg(F.sum(sign).alias("n"))
    return balance.groupBy("question_id").agg((F.count_if(F.col("n") != 0) == 0).alias("equal"))


def _pair_prints(rows: DataFrame) -> DataFrame:
    """``question_id, side, i, j, fp, same`` for each two columns: a fingerprint of their pairs of values, and whether they are equal in
    all rows. Two columns of a row are one row here, but pairs are summed in tasks first; what is unfolded are numbers of
    pairs, so a row is not copied for them."""
    n, p = F.size("vals").cast("bigint"), F.col("p")
    pairs = F.floor(n * (n - 1) / 2)
    numbered = rows.filter("size(vals) > 1").select("question_id", "side", "pos", "vals", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), pairs - 1)).alias("p"))
    j = F.floor((1 + F.sqrt(1 + 8 * p)) / 2).cast("int")  # pairs in the order (0, 1), (0, 2), (1, 2), (0, 3) and so on
    i = (p - F.floor(j.cast("bigint") * (j - 1) / 2)).cast("int")
    each = numbered.select("question_id", "side", "pos", i.alias("i"), j.alias("j"), F.get("vals", i).alias("x"), F.get("vals", j).alias("y"))
    prints = each.groupBy("question_id", "side", "i", "j").agg(
        fingerprint(F.col("pos"), F.col("x"), F.col("y")).alias("xy"), fingerprint(F.col("pos"), F.col("y"), F.col("x")).alias("yx"), F.bool_and(F.col("x") == F.col("y")).alias("same"))
    both = F.explode(F.array(F.struct("i", "j", F.col("xy").alias("fp")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("yx").alias("fp")))).alias("p")
    return prints.select("question_id", "side", "same", both).select("question_id", "side", "p.*", "same")


def refine(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """Colours ``question_id, side, col_no, fp`` of the columns that are left to pair, and how many rounds they took.

    ``rows``: question_id, side, pos, vals; ``classes``: question_id, classes (the class of each column). Columns that are equal in all
    rows are one, with their number in the colour. A column's colour then takes in, for every other column, the fingerprint of
    the two together and the other's colour, until no class falls apart any more. A mapping of the results keeps
    colours, so only columns of one colour have to be tried on each other."""
    keys = ["question_id", "side"]
    pairs = cut_lineage(_pair_prints(rows))
    first = pairs.filter("same").groupBy(*keys, "i").agg(F.min("j").alias("least"), F.count("*").alias("n"))
    sides = F.explode(F.array(F.lit(GOLD), F.lit(PRED))).alias("side")
    columns = classes.select("question_id", sides, F.posexplode("classes").alias("i", "class")).join(first, [*keys, "i"], "left")
    columns = columns.filter(F.coalesce(F.col("least") > F.col("i"), F.lit(True)))
    colours = cut_lineage(columns.select(*keys, "i", F.xxhash64("class", F.coalesce("n", F.lit(0))).alias("fp")))
    kept = colours.select(*keys, "i")
    pairs = cut_lineage(pairs.join(kept, [*keys, "i"], "left_semi").join(kept.withColumnRenamed("i", "j"), [*keys, "j"], "left_semi"))
    rounds, parts = 0, 0
    while True:
        now = colours.groupBy(*keys).agg(F.count_distinct("fp").alias("n")).agg(F.sum("n")).first()[0] or 0
        if now == parts:
            return colours.withColumnRenamed("i", "col_no"), rounds
        parts, rounds = now, rounds + 1
        seen = pairs.join(colours.select(*keys, F.col("i").alias("j"), F.col("fp").alias("colour")), [*keys, "j"])
        around = seen.groupBy(*keys, "i").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("fp", "colour")))).alias("around"))
        colours = cut_lineage(colours.join(around, [*keys, "i"], "left").select(*keys, "i", F.xxhash64("fp", "around").alias("fp")))


def resolve(placed: DataFrame, unclear: DataFrame) -> DataFrame:
    """``question_id`` of the questions for which some column mapping makes both sides equal.

    ``placed``: question_id, side, pos, vals; ``unclear``: question_id, classes. Colours settle what they can: different
    colours on the two sides mean no mapping, and a colour for each column leaves one to confirm. What is left is searched inside
    its colours."""
    rows = stage_rows(_salted_join(placed, unclear.select("question_id"), F.xxhash64("side", "pos", "vals")), "unclear")
    plain = rows.withColumn("ordered", F.lit(True))  # as given: their positions count where there are any
    return _resolved(rows, unclear, lambda slots: _placed(plain, slots))


def _resolved(rows: DataFrame, unclear: DataFrame, in_order: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``resolve`` for rows of these questions alone; ``in_order`` gives them with their columns in the order of slots."""
    slots = cut_lineage(_slots(refine(rows, unclear)[0]).filter("comparable"))
    ordered = in_order(slots)
    done = cut_lineage(slots.join(equal_bags(ordered), "question_id"))
    found = done.filter("equal").select("question_id")
    left = done.filter("ambiguous and not equal").select(
        "question_id", "classes", F.slice(F.sequence(F.lit(-1), F.col("n_single") - 1), F.lit(2), F.col("n_single")).alias("prefix"))
    return found if left.isEmpty() else found.union(search_mappings(ordered, left))


def search_mappings(rows: DataFrame, start: DataFrame) -> DataFrame:
    """Questions for which some column mapping makes both sides equal.

    ``rows``: question_id, side, pos, vals with columns in slot order. ``start``:
    question_id, classes (the class of each slot) and prefix (slots already decided).
    A depth-first search that advances all questions together: each step extends the
    deepest open prefix of every question by one column and keeps the extensions whose
    value tuples have the gold fingerprint. It ends when every question has a confirmed
    mapping or no prefix left, so it is exact, without a limit on columns. What it keeps
    between steps is a list of prefixes, not rows.
    """
    rows = stage_rows(_salted_join(rows, start.select("question_id"), F.xxhash64("side", "pos", "vals")), "searched")
    classes = cut_lineage(start.select("question_id", "classes"))
    frontier = cut_lineage(start.select("question_id", "prefix"))
    found = frontier.limit(0).select("question_id")
    while not frontier.isEmpty():
        top = frontier.groupBy("question_id").agg(F.max(F.struct(F.size("prefix").alias("n"), "prefix")).alias("t"))
        top = cut_lineage(top.select("question_id", F.col("t.prefix").alias("prefix")).join(classes, "question_id"))
        full = top.filter(F.size("prefix") == F.size("classes"))
        confirmed = _confirm(rows, full)
        grown = _extend(rows, top.filter(F.size("prefix") < F.size("classes")))
        found = cut_lineage(found.union(confirmed))
        rest = frontier.join(top.select("question_id", "prefix"), ["question_id", "prefix"], "left_anti")
        frontier = cut_lineage(rest.union(grown).join(found, "question_id", "left_anti"))
    return found


def _extend(rows: DataFrame, top: DataFrame) -> DataFrame:
    depth = F.size("prefix")
    wanted = F.element_at("classes", depth + 1)
    free = F.filter(F.sequence(F.lit(0), F.size("classes") - 1), lambda i: (F.element_at("classes", i + 1) == wanted)
                    & ~F.array_contains("prefix", i))
    joined = _salted_join(rows, top, F.xxhash64("side", "pos", "vals"))
    tried = joined.withColumn("cand", F.explode(F.when(F.col("side") == GOLD, F.array(F.lit(-1))).otherwise(free)))
    taken = F.when(F.col("side") == GOLD, F.slice("vals", F.lit(1), depth + 1)).otherwise(
        F.transform(F.concat("prefix", F.array("cand")), lambda i: F.element_at("vals", i + 1)))
    prints = tried.select("question_id", "prefix", "cand", "pos", taken.alias("taken")).groupBy("question_id", "prefix", "cand").agg(
        fingerprint(F.col("pos"), F.col("taken")).alias("fp"))
    gold = prints.filter("cand = -1").select("question_id", "fp")
    kept = prints.filter("cand >= 0").join(gold, ["question_id", "fp"])
    return kept.select("question_id", F.concat("prefix", F.array("cand")).alias("prefix"))


def _confirm(rows: DataFrame, full: DataFrame) -> DataFrame:
    joined = _salted_join(rows, full, F.xxhash64("side", "pos", "vals"))
    mapped = F.when(F.col("side") == GOLD, F.col("vals")).otherwise(F.transform("prefix", lambda i: F.element_at("vals", i + 1)))
    return equal_bags(joined.select("question_id", "side", "pos", mapped.alias("vals"))).filter("equal").select("question_id")


def compare_batch(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """Verdicts for results held as cells (question_id, side, row_no, col_no, value)."""
    return compare_rows(headers, rows_of_cells(cells))


def headers_of_cells(cells: DataFrame, ordered: Column) -> DataFrame:
    """Headers for results that have at least one row."""
    return cells.groupBy("question_id", "side").agg(
        F.count_distinct("row_no").alias("n_rows"), F.count_distinct("col_no").alias("n_cols"),
        F.lit(None).cast("string").alias("error"), F.bool_or(ordered).alias("ordered"))
