"""Near duplicates by Order MinHash, verified by banded alignment.

Shingles are runs of five words; texts of one to four words are one shingle. Occurrences of a shingle are labelled, and of those
after the first the 2nd, 4th, 8th and so on count: one phrase repeated hundreds of times makes texts no candidates. Each of ``SKETCHES`` hash functions samples the ``TUPLE`` smallest shingles of a
text and keeps them in text order; texts that share ``SHARED`` such tuples are candidates. Of 24 tuples, each shared with
probability 0.8^3, a pair at similarity 0.8 shares fewer than three once in 90,000 times.

Two texts are linked if at least 0.8 of their distinct shingles are shared (Jaccard) and the words that a banded
alignment matches are 0.8 of the longer text. Classes are the connected components.

Exact copies are collapsed before anything is compared. The texts that share one tuple are a bucket; its least member
is compared with the others. Groups of copies thus become one class at one comparison a member. What shares a tuple across
classes, such as texts with a common passage, is dealt anew by rare shingles: with the shingles of each text ordered by the number
of these texts that have them, two texts that share what the similarity asks for have their rarest common shingle where as many
follow in both. A passage, however many texts have it, thus joins those only of which it is nearly all. In the buckets that still
hold several classes, growing random sets of leaders are compared with the members of other classes, until all members were leaders
or one class is left. So no candidate pair of different classes that can be near is left out; the price is that texts put together
from frequent passages alone, without being near, are compared in pairs.

A class id is the least doc_id of its class. Texts without words (null, empty, blank) are each their own class. A row with
a null doc_id gets the class of its exact copies, else null. Rows with equal doc_id count as one document. Empty tables
give no rows; other columns are kept by ``keep_one`` and not read by ``classes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.components import components
from semaspark.llm.frames import free_name, salted_join, stage, table
from semaspark.llm.words import SMALL_CHUNK, Texts, chunks, in_row, mix, whole_windows, windows

SHINGLE = 5
SKETCHES = 24
SHARED = 3
LEADERS = 32
TUPLE = 3
SIMILAR = 0.8
SIZES = 1.1  # a size class ends where it is this many times its least
_MOST = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64)).reshape(2, SKETCHES) | np.uint64(1)
SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and their rows."""
    at = np.flatnonzero(whole_windows(row, SHINGLE))
    out, of = windows(hashes, row, SHINGLE)[at], row[at]
    size = np.bincount(row, minlength=rows)
    first = np.cumsum(size) - size
    for k in range(1, SHINGLE):
        short = np.flatnonzero(size == k)
        if len(short):
            out, of = np.concatenate((out, windows(hashes, row, k)[first[short]])), np.concatenate((of, short))
    order = np.argsort(of, kind="stable")
    return out[order], of[order]


def _sketch(part: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, and for each row and hash function the hash of its ordered tuple."""
    start, end, row = part.words()
    item, of = shingles(part.hashes(start, end), row, part.rows)
    _, which, count = np.unique(in_row(item, of), return_inverse=True, return_counts=True)
    order = np.argsort(which, kind="stable")
    nth = np.empty(len(item), np.int64)
    nth[order] = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    distinct = np.bincount(of[nth == 0], minlength=part.rows)
    counts = ((nth + 1) & nth) == 0
    item, of, nth = item[counts], of[counts], nth[counts]
    item = mix(item + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    size = np.bincount(of, minlength=part.rows)
    full = np.flatnonzero(size)
    size, first = size[full], (np.cumsum(size) - size)[full]
    out = np.zeros((part.rows, SKETCHES), np.uint64)
    for j in range(SKETCHES if len(full) else 0):
        v = (item ^ _SEEDS[0, j]) * _SEEDS[1, j]
        v ^= v >> np.uint64(31)
        places = np.full((TUPLE, len(full)), len(item), np.int64)
        for t in range(TUPLE):
            least = np.minimum.reduceat(v, first)
            at = np.flatnonzero(v == np.repeat(least, size))
            mine = np.searchsorted(first, at, "right") - 1
            at, mine = at[least[mine] != _MOST], mine[least[mine] != _MOST]
            places[t, mine[::-1]] = at[::-1]
            v[at] = _MOST
        places.sort(axis=0)
        padded = np.concatenate((item, np.zeros(1, np.uint64)))
        key = np.full(len(full), _SEEDS[1, j], np.uint64)
        for t in range(TUPLE):
            key = mix(key + padded[places[t]])
        out[full, j] = key
    return distinct, out


@F.arrow_udf(SKETCH)
def sketch(texts: pa.Array) -> pa.Array:
    made = [_sketch(p) for p in chunks(texts, SMALL_CHUNK)]
    n = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int64)
    values = np.concatenate([m[1] for m in made]) if made else np.zeros((0, SKETCHES), np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCHES), pa.array(values.view(np.int64).ravel()))
    return pa.StructArray.from_arrays([pa.array(n), lists], ["n", "buckets"])


@F.arrow_udf(T.BinaryType())
def word_codes(texts: pa.Array) -> pa.Array:
    """32-bit word hashes of each text, as bytes."""
    out: list[bytes] = []
    for part in chunks(texts, SMALL_CHUNK):
        start, end, row = part.words()
        code = (part.hashes(start, end) >> np.uint64(32)).astype("<u4")
        upto = np.searchsorted(row, np.arange(part.rows + 1))
        out += [code[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
    return pa.array(out, pa.binary())


def aligned_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words that an alignment matches in order, where matched places differ by at most ``band``.

    One bit per word of ``a`` says where the longest common subsequence grows; the words of ``b`` are taken in
    blocks, and a block touches only the bits inside its band."""
    ahead = 0
    while ahead < min(len(a), len(b)) and a[ahead] == b[ahead]:
        ahead += 1
    a, b = a[ahead:], b[ahead:]
    if not len(a) or not len(b):
        return ahead
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    bits, words, step = full, b.tolist(), max(64, band)
    for j in range(0, len(words), step):
        low, high = max(0, j - band), min(len(a), j + step + band)
        if low >= high:
            break
        mask = (1 << (high - low)) - 1
        v = (bits >> low) & mask
        for w in words[j : j + step]:
            m = (places.get(w, 0) >> low) & mask
            u = v & m
            v = ((v + u) | (v - u)) & mask
        bits = (bits & ~(mask << low)) | (v << low)
    return ahead + len(a) - (bits & full).bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two texts, as word codes, are near duplicates."""
    zero = np.zeros(max(len(a), len(b)), np.int64)
    x, y = (np.unique(shingles(w.astype(np.uint64), zero[: len(w)], 1)[0]) for w in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < least * (len(x) + len(y) - both):
        return False
    longer = max(len(a), len(b))
    return aligned_words(a, b, int((1 - least) * longer) + 1) >= least * longer


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wa, wb = batch.column(2), batch.column(3)
        good = [similar(np.frombuffer(wa[i].as_buffer(), "<u4"), np.frombuffer(wb[i].as_buffer(), "<u4")) for i in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near duplicates."""
    left = words.select(F.col("node").alias("a"), F.col("codes").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("codes").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(_verify, "a long, b long")


def _pairs(one: str, two: str, n_one: str, n_two: str) -> list:
    """Conditions and columns of candidate pairs; sizes that differ too much can't reach the similarity."""
    return [F.least(n_one, n_two) >= SIMILAR * F.greatest(n_one, n_two), F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def near_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root of all nodes that have a near duplicate. nodes: node, n, buckets; docs: doc_id, text."""
    each = nodes.select("node", "n", F.posexplode("buckets").alias("at", "value")).select("node", "n", F.xxhash64("at", "value").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("c")).where("c > 1")
    members = stage(each.join(sizes.select("bucket", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n")), "bucket"), "members")
    words = docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), word_codes("text").alias("codes"))
    words = stage(words.dropDuplicates(["node"]), "words")
    fits, a, b = _pairs("leader", "node", "leader_n", "n")
    root = stage(components(_links(members.where((F.col("leader") != F.col("node")) & fits).select(a, b).distinct(), words)), "roots")
    # Buckets of several classes, and of those the pairs that a text is in.
    now = members.join(root, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    text = stage(_mixed(now, "bucket").groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("b"), F.first("root").alias("root")).where(F.size("b") >= SHARED), "mixed")
    spread = F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) / float(1 << 30)
    now = stage(rare_buckets(text.select("node", "root"), words), "rare")
    c = now.groupBy("bucket").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket", "c")
    now = stage(now.join(c, "bucket").withColumn("turn", spread * F.col("c")).join(text.select("node", "b"), "node"), "mixed")
    turn, leaders = 0.0, float(LEADERS)
    while True:
        lead = now.where((F.col("turn") >= turn) & (F.col("turn") < leaders))
        if lead.isEmpty():
            return root
        lead = lead.select("bucket", F.col("node").alias("one"), F.col("n").alias("one_n"), F.col("root").alias("one_root"), F.col("turn").alias("one_turn"), F.col("b").alias("one_b"), F.col("room").alias("one_room"), F.col("size").alias("one_size"))
        fits, a, b = _pairs("one", "node", "one_n", "n")
        fresh = (F.col("turn") > F.col("one_turn")) | ((F.col("turn") == F.col("one_turn")) & (F.col("node") > F.col("one")))
        # All tuples that two texts of different classes share are in both lists.
        shared = F.size(F.array_intersect("b", "one_b")) >= SHARED
        enough = (F.col("other") == F.col("one_size")) & (9 * F.least("room", "one_room") >= 4 * (F.col("n") + F.col("one_n")))
        todo = now.join(lead, "bucket").where((F.col("root") != F.col("one_root")) & fresh & fits & enough & shared).select(a, b).distinct()
        found = stage(_links(todo, words), "near")
        if not found.isEmpty():
            root = stage(_merged(root, found), "roots")
            newer = root.withColumnRenamed("root", "newer")
            now = now.join(newer, "node", "left").withColumn("root", F.coalesce("newer", "root")).drop("newer")
        now = stage(_mixed(now, "bucket"), "mixed")
        turn, leaders = leaders, leaders * 4


@F.arrow_udf(T.ArrayType(T.LongType()))
def distinct_shingles(codes: pa.Array) -> pa.Array:
    """The distinct shingles of each text, as ``similar`` counts them."""
    out = []
    for c in codes:
        w = np.frombuffer(c.as_buffer(), "<u4")
        out.append(np.unique(shingles(w.astype(np.uint64), np.zeros(len(w), np.int64), 1)[0]).view(np.int64))
    at = np.cumsum([0, *map(len, out)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))


def rare_buckets(text: DataFrame, words: DataFrame) -> DataFrame:
    """node, root, n, room, size, other, bucket: the places where a text can have its rarest shingle in common with a near one.

    Shingles go from rare to frequent, ties by value. Similarity 0.8 means 9 * shared >= 4 * (sizes of both), and what two texts share lies
    at their rarest common shingle or after it, where ``room`` shingles are left. So a place holds for partners of
    sizes up to 9 / 4 * room - n; buckets are a shingle and the size classes of both. text: node, root; words: node, codes."""
    each = text.join(words, "node").select("node", "root", distinct_shingles("codes").alias("items"))
    each = each.select("node", "root", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    seen = each.groupBy("item").agg(F.count("*").alias("seen")).where("seen > 1")
    order = Window.partitionBy("node").orderBy(F.desc("seen"), F.desc("item"))
    placed = each.join(seen, "item").withColumn("room", F.row_number().over(order).cast("long"))
    least, most = F.expr("(4 * n + 4) div 5"), F.least(F.expr("5 * n div 4"), F.expr("9 * room div 4 - n"))
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZES))
    placed = placed.where(least <= most).withColumn("size", size(F.col("n"))).withColumn("other", F.explode(F.sequence(size(least), size(most))))
    bucket = F.xxhash64("item", F.least("size", "other"), F.greatest("size", "other"))
    return placed.select("node", "root", "n", "room", "size", "other", bucket.alias("bucket"))


def _mixed(rows: DataFrame, bucket: str) -> DataFrame:
    """The rows of buckets that hold more than one class."""
    several = rows.groupBy(bucket).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(bucket)
    return rows.join(several, bucket, "left_semi")


def _merged(root: DataFrame, found: DataFrame) -> DataFrame:
    """The classes of ``root`` after the links ``found``: only classes are linked, not their members again."""
    of_a, of_b = (root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    links = found.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = stage(components(links), "merged")
    old = root.join(joined.select(F.col("node").alias("root"), F.col("root").alias("newer")), "root", "left").select("node", F.coalesce("newer", "root").alias("root"))
    return old.unionAll(joined.join(root.select("node"), "node", "left_anti").select("node", "root"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_shingles: one row per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = rows.select("doc_id", F.md5("text").alias("copy"), sketch("text").alias("s"))
    made = stage(made.select("doc_id", "copy", "s.n", "s.buckets"), "sketches")
    full = made.where("n > 0")
    copies = full.groupBy("copy").agg(F.min("doc_id").alias("node"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    copies = stage(copies.where(F.col("node").isNotNull()), "copies")
    root = near_links(copies.select("node", "n", "buckets"), rows)
    # Only texts with copies need their node looked up; both sides are narrow and hot keys are salted.
    first = salted_join(full.select("doc_id", "copy", "n"), copies.where("c > 1").select("copy", "node"), "copy", F.coalesce("doc_id", F.lit(0)))
    first = first.select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    found = salted_join(first, root.withColumnRenamed("root", "class_id"), "node", F.coalesce("doc_id", F.lit(0)))
    found = found.select("doc_id", F.coalesce("class_id", "node").alias("class_id"), F.col("n").alias("n_shingles"))
    return found.unionAll(made.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("n").alias("n_shingles")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document of each class whose id is the class's, with all its columns. Rows without an id stay."""
    name, same = free_name(docs, "class_id"), free_name(docs, "gone")
    lost = classes(docs, doc_id, text).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(lost.withColumn(same, F.lit(True)), F.col(doc_id) == F.col(name), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
