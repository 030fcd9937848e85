"""Conversations as a Z-fast trie: which prefixes they share, and what sharing saves.

A conversation is its turns in the order of ``turn`` (null first; ties by the MD5 of role and text); null role and text are
empty, and rows without conv_id belong to none. Every prefix has a 128-bit signature, so a text is read once.

The trie is a table of compacted nodes. A node spans the depths (lo, hi] below its parent, keeps the signature of each, and is
looked up by the signature at its handle, the depth in (lo, hi] that the greatest power of two divides. A
conversation of n turns finds its exit node by fat binary search: it looks up its signature at the two-fattest depth
of (a, b], goes on below the node if that lies wholly on its path, and else, without a node, above the depth; a
node that it leaves inside is the exit, or the child that starts with its next turn. All conversations search at
once, one join a step, at most as many steps as the greatest depth has bits.

Batches. All open conversations are searched, the edges are cut at the depths where they leave or end, and of those that
leave at one place by one next turn one, drawn by hash, becomes a leaf; the others search again, from the
node that they have reached. A leaf drawn at random halves what stays open below it, so batches are few. Equal conversations are one
row with a count from the start, so a conversation repeated any number of times is searched once.

Sums over subtrees double their reach each step (each node adds the sums of the nodes that point to it, then points
where those point). At last each edge is expanded to one row a depth.

Joins on a popular node are split by Spark's adaptive skew join, grouped sums combine in tasks first. The ids that end at one node are packed by ranges in
sorted order and hashed as a stream. What one row holds of a conversation is 24 bytes a turn. Empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaspark.llm.curve import CRC_SQL, crc32_sql
from semaspark.llm.frames import stage, table
from semaspark.llm.words import mix

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20
SHARED = 4
_LANES = ((0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
ROOT = b""


def own_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order, as key and words."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))).alias("key")
    one = F.struct(F.col(turn).alias("turn"), key, F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"))
    turns = conversations.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """Each conversation with its first turns taken from the first of its family."""
    turns = stage(turns, "turns")
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, shared - 1).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    joined = turns.withColumns({"head": base, "h": h}).join(heads, "head", "left")
    none = F.array().cast(turns.schema["turns"].dataType)
    start = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit signature of each prefix of each row; ``keys`` has 16 bytes a turn as two uint64, ``bounds`` cuts rows."""
    n = len(keys)
    place = np.arange(n, dtype=np.int64) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.empty((n, 2), np.uint64)
    for lane, (base, step) in enumerate(_LANES):
        powers = np.full(int(place.max(initial=0)) + 1, base, np.uint64)
        powers[0] = 1
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(keys[:, lane] + np.uint64(step) * keys[:, 1 - lane]) * np.cumprod(powers, dtype=np.uint64)[place], out=upto[1:])
        mine = upto[1:] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
        out[:, lane] = mix(mine + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(step))
    return out


PREFIXES = T.StructType([T.StructField("sig", T.ArrayType(T.BinaryType())), T.StructField("cum", T.ArrayType(T.LongType()))])


@F.arrow_udf(PREFIXES)
def _prefixes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for keys, words in batches:
        bounds = np.concatenate(([0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        flat = keys.flatten()
        sig = np.ascontiguousarray(prefix_signatures(np.frombuffer(b"".join(flat.to_pylist()), np.uint64).reshape(-1, 2), bounds))
        values = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, 16 * len(flat) + 1, 16, dtype=np.int32)), pa.py_buffer(sig)])
        upto = np.concatenate(([0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
        cum = upto[1:] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
        cuts = pa.array(bounds, pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, values), pa.ListArray.from_arrays(cuts, pa.array(cum))], ["sig", "cum"])


def signed(conversations: DataFrame) -> DataFrame:
    """conv_id, n, id (the signature of the whole), and a turn's prefix signature and words so far in sig and cum."""
    parts = _prefixes(F.transform("turns", lambda x: x["key"]), F.transform("turns", lambda x: x["words"]))
    n = F.size("p.sig")
    return conversations.select("conv_id", parts.alias("p")).select("conv_id", n.alias("n"), _at("p.sig", n).alias("id"), "p.sig", "p.cum")


def _at(sig: str, depth: Column) -> Column:
    """The signature at a depth; the root's is empty."""
    return F.when(depth > 0, F.get(sig, depth - 1)).otherwise(F.lit(ROOT))


def _upto(cum: str, depth: Column) -> Column:
    """The words of the first turns, as many as ``depth``."""
    return F.when(depth > 0, F.get(cum, depth - 1)).otherwise(F.lit(0).cast("long"))


def two_fattest(low: Column, high: Column) -> Column:
    """Of the numbers in (low, high], the one that the greatest power of two divides."""
    top = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    return F.call_function("shiftleft", F.lit(-1), top).bitwiseAND(high).cast("int")


def _no_key(own: Column) -> Column:
    """A join key that no signature equals and that no two rows share: rows that look nothing up stay spread."""
    return F.concat(own, F.lit(b"-"))


def _search(open_: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``open_`` with a, the depth of the deepest node wholly on the path, and the exit below it, if there is one:
    the span x_lo, x_hi and the signatures x_sig of the edge that the path enters and leaves, or ends in."""
    look = nodes.select(F.get("edge", F.col("handle") - F.col("lo") - 1).alias("look"), F.struct("lo", "hi", "edge").alias("hit"))
    found = open_.withColumns({"b": F.col("n"), "x": F.lit(None).cast(look.schema["hit"].dataType)})
    for _ in range(steps):
        active = F.col("x").isNull() & (F.col("a") < F.col("b"))
        f = two_fattest(F.col("a"), F.col("b"))
        found = found.withColumns({"on": active, "f": F.when(active, f)})
        found = found.withColumn("look", F.when(F.col("on"), _at("sig", F.col("f"))).otherwise(_no_key(F.col("id"))))
        found = found.join(look, "look", "left")
        hi = F.col("hit.hi")
        whole = F.coalesce((hi <= F.col("n")) & (_at("sig", hi) == F.element_at("hit.edge", -1)), F.lit(False))
        missed = F.col("on") & F.col("hit").isNull()
        found = found.select(*open_.drop("a").columns, F.when(whole, hi).otherwise(F.col("a")).alias("a"), F.when(missed, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
                             F.when(F.col("hit").isNotNull() & ~whole, F.col("hit")).otherwise(F.col("x")).alias("x"))
    entry = nodes.select(F.get("edge", F.lit(0)).alias("look"), F.struct("lo", "hi", "edge").alias("hit"))
    last = F.col("x").isNull() & (F.col("a") < F.col("n"))
    found = found.withColumn("look", F.when(last, _at("sig", F.col("a") + 1)).otherwise(_no_key(F.col("id")))).join(entry, "look", "left")
    return found.select(*open_.columns, F.coalesce("x", "hit").alias("x"))


def _leave(found: DataFrame) -> DataFrame:
    """With e, the depth at which the path leaves the trie or ends."""
    lo, edge = F.col("x.lo"), F.col("x.edge")
    within = F.least(F.col("x.hi"), F.col("n")) - lo
    alike = F.size(F.filter(F.sequence(F.lit(1), within), lambda i: F.element_at(edge, i) == F.element_at(F.col("sig"), (lo + i).cast("int"))))
    return found.withColumn("e", F.when(F.col("x").isNull(), F.col("a")).otherwise(lo + alike))


NODE = ("lo", "hi", "handle", "up", "above", "edge", "cum")


def _node(lo: Column, hi: Column, sig: str, cum: str, base: Column) -> list[Column]:
    """A node over (lo, hi] cut from arrays that begin at depth ``base`` + 1."""
    def cut(c: str) -> Column:
        return F.slice(c, (lo - base + 1).cast("int"), (hi - lo).cast("int"))

    return [lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), two_fattest(lo, hi).alias("handle"), cut(sig).alias("edge"), cut(cum).alias("cum")]


def build(sequences: DataFrame) -> DataFrame:
    """The compacted nodes of the trie over distinct sequences (id, n, sig, cum), without the root."""
    deepest = sequences.agg(F.max("n")).first()[0] or 0
    steps = int(deepest).bit_length()
    open_, nodes = sequences.where("n > 0").withColumn("a", F.lit(0)), None
    while True:
        if nodes is None:
            exits = open_.withColumns({"e": F.lit(0), "x_end": F.lit(None).cast("binary"), "x_hi": F.lit(None).cast("int")})
        else:
            found = _leave(_search(open_, nodes, steps)).where("a < n")
            exits = found.withColumns({"x_end": F.element_at("x.edge", -1), "x_hi": F.col("x.hi")}).drop("x")
        exits = stage(exits, "exits")
        if nodes is not None and exits.isEmpty():
            return nodes
        leaving = exits.where("e < n")
        drawn = leaving.groupBy(_at("sig", F.col("e") + 1).alias("next")).agg(F.min(F.struct(F.xxhash64("id").alias("draw"), "id")).alias("lead"))
        leads = stage(leaving.join(drawn.select(F.col("lead.id").alias("id")), "id", "left_semi"), "leads")
        new = leads.select(*_node(F.col("e"), F.col("n"), "sig", "cum", F.lit(0)), _at("sig", F.col("e")).alias("up"), _upto("cum", F.col("e")).alias("above"))
        grown = new if nodes is None else _cut(nodes, exits).unionByName(new)
        nodes = stage(grown.select(*NODE), "nodes")
        # The others have passed the node that now ends at e.
        open_ = leaving.join(leads.select("id"), "id", "left_anti").withColumn("a", F.col("e")).select("id", "n", "sig", "cum", "a")


def _cut(nodes: DataFrame, exits: DataFrame) -> DataFrame:
    """``nodes`` with each edge cut where a path leaves it or ends in it."""
    cuts = exits.where("e < x_hi").groupBy("x_end").agg(F.collect_set("e").alias("cuts"))
    pieces = nodes.withColumn("x_end", F.element_at("edge", -1)).join(cuts, "x_end", "left")
    ends = F.sort_array(F.array_union(F.coalesce("cuts", F.array().cast("array<int>")), F.array("lo", "hi")))
    pieces = pieces.withColumn("ends", ends).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)))
    pieces = pieces.withColumns({"p": F.get("ends", F.col("i") - 1), "q": F.get("ends", F.col("i"))})
    into = F.col("p") - F.col("lo")
    up = F.when(into > 0, F.get("edge", into - 1)).otherwise(F.col("up"))
    above = F.when(into > 0, F.get("cum", into - 1)).otherwise(F.col("above"))
    return pieces.select(*_node(F.col("p"), F.col("q"), "edge", "cum", F.col("lo")), up.alias("up"), above.alias("above"))


SUMS = ("members", "leaves", "deep", "wide")


def totals(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """id, up, n_children, and over what lies below each node, itself included: members, least conv_id, leaves, the words of
    all members from the root on (deep) and the words of all depths from the node's own on (wide)."""
    kids = nodes.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    here = nodes.select(F.element_at("edge", -1).alias("id"), "up", (F.element_at("cum", -1) - F.col("above")).alias("wide"), F.element_at("cum", -1).alias("words"))
    here = here.join(kids, "id", "left").join(ends, "id", "left")
    state = stage(here.select("id", "up", F.when(F.col("up") != F.lit(ROOT), F.col("up")).alias("ptr"), F.coalesce("n_children", zero).alias("n_children"), F.coalesce("members", zero).alias("members"),
                              F.col("n_children").isNull().cast("long").alias("leaves"), (F.coalesce("members", zero) * F.col("words")).alias("deep"), "wide", "least"), "sums")
    while not state.where("ptr IS NOT NULL").isEmpty():
        pointed = state.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("id"))
        below = pointed.agg(*(F.sum(c).alias(f"{c}_below") for c in SUMS), F.min("least").alias("least_below"))
        onward = state.select(F.col("id").alias("jump"), F.col("ptr").alias("next"))
        moved = state.withColumn("jump", F.coalesce("ptr", _no_key(F.col("id")))).join(onward, "jump", "left").join(below, "id", "left")
        state = stage(moved.select("id", "up", F.col("next").alias("ptr"), "n_children", *((F.col(c) + F.coalesce(f"{c}_below", zero)).alias(c) for c in SUMS),
                                   F.least("least", "least_below").alias("least")), "sums")
    return state.drop("ptr")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (id, first, ids) to one SHA-256 an id; only the hash of the id at hand is held."""
    now, digest = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
            if digest is None or key != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        if done:
            yield _hashed(done)
    if digest is not None:
        yield _hashed([(now, digest.hexdigest())])


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([v for _, v in done], pa.string())], ["id", "ends_sha256"])


def end_hashes(members: DataFrame) -> DataFrame:
    """id and the SHA-256 of the ascending decimal conv_ids that have it. Ids are packed by ranges of the sorted order, so what
    a popular id sends to its one task is a text a range; the hash of a sequence has to read it in one place."""
    ranged = members.select("id", "conv_id").repartitionByRange("id", "conv_id")
    packed = ranged.groupBy("id", F.spark_partition_id().alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("c"))
    texts = packed.select("id", F.get("c", F.lit(0)).alias("first"), F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("ids"))
    return texts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_hash_runs, "id binary, ends_sha256 string")


def trie_report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over conversations (conv_id, turns with key and words)."""
    members = stage(signed(conversations), "members")
    whole = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    alike = members.groupBy("id").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("cum").alias("cum"))
    sequences = stage(alike, "sequences")
    nodes = build(sequences.select("id", "n", "sig", "cum"))
    sums = totals(nodes, sequences.select("id", "members", "least"))
    ends = stage(end_hashes(members), "ends")
    none = F.lit(hashlib.sha256().hexdigest())
    parents = sums.select(F.col("id").alias("jump"), F.col("least").alias("parent_least"))
    edges = nodes.select(F.element_at("edge", -1).alias("id"), "lo", "hi", "above", "cum").join(sums, "id").join(ends, "id", "left")
    edges = edges.withColumn("jump", F.when(F.col("up") != F.lit(ROOT), F.col("up")).otherwise(_no_key(F.col("id")))).join(parents, "jump", "left")
    edges = edges.withColumn("depth", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))))
    into, last = F.col("depth") - F.col("lo") - 1, F.col("depth") == F.col("hi")
    passed = F.when(into > 0, F.get("cum", into - 1) - F.col("above")).otherwise(F.lit(0).cast("long"))
    saved = F.col("deep") - F.col("members") * F.col("above") - F.col("wide") - (F.col("members") - 1) * passed
    parent = F.when(into > 0, F.col("least")).otherwise(F.coalesce("parent_least", F.lit(whole["least"])))
    rows = edges.select(F.col("least").cast("long").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"),
                        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
                        F.when(last, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"))
    if not whole["n"]:
        return rows
    top = sums.where(F.col("up") == F.lit(ROOT)).agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum(F.col("deep") - F.col("wide")).alias("saved")).first()
    here = ends.where(F.col("id") == F.lit(ROOT)).first()
    values = (int(whole["least"]), 0, None, whole["n"], top["n"], top["leaves"] or 1, top["saved"] or 0, here["ends_sha256"] if here else hashlib.sha256().hexdigest())
    root = rows.sparkSession.range(1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, rows.schema.fields)))
    return rows.unionByName(root)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(rebuilt(own_turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = rf"""
WITH c AS ({CRC_SQL}),
t AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM t),
v AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), c),
f AS (SELECT v.conv_id, o.i AS d, o.key, o.words FROM v JOIN o ON o.conv_id = v.base AND o.i <= v.h),
r AS (SELECT * FROM f UNION ALL SELECT v.conv_id, o.i - v.h + (SELECT count(*) FROM f WHERE f.conv_id = v.conv_id), o.key, o.words FROM v JOIN o ON o.conv_id = v.conv_id AND o.i > v.h),
p AS (SELECT conv_id, d, words, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM v),
n AS (SELECT node, d, min(conv_id) AS least, count(*) AS n, any_value(words) AS words FROM p GROUP BY node, d),
k AS (SELECT left(node, 32 * (d - 1)) AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT left(n.node, 32 * j) AS node, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (k.kids IS NULL) AS leaves
  FROM n LEFT JOIN k ON k.node = n.node, unnest(range(n.d + 1)) AS x(j) GROUP BY 1),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY node)
SELECT n.least AS conv_id, CAST(n.d AS BIGINT) AS depth, m.least AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children, u.leaves AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n m ON n.d > 0 AND m.node = left(n.node, 32 * (n.d - 1)) LEFT JOIN k ON k.node = n.node JOIN u ON u.node = n.node LEFT JOIN e ON e.node = n.node
"""
