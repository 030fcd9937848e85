"""Exact top-k by inner product: ball trees in shards, branch and bound over blocks of queries.

Candidates are dealt by hash into shards of about ``SHARD`` vectors. Each shard builds one ball tree: nodes with a centre c and a
radius r, so that q.c + |q| r bounds the inner product of q with every vector below. Equal vectors of a shard become one entry
with its k + 1 least ids, which is all that any answer can need.

Queries come in blocks of about ``BLOCK``; a shard meets every block once, in a group of its own, so the memory of a task has
a bound that the table's size does not move. In a first round each query looks into the leaf with the best bound in every
shard; Spark takes the k best of all shards, and the k-th score is shared: the second round starts from it, visits leaves
from the highest bound down and stops at the first that lies below the k-th score so far.

Components become floor(scale * x), kept within +-2^28 so that scores of up to 64 components stay in 64 bits. Vectors that are null or hold a null or
a non-finite component take no part, nor do rows without id. Rows that repeat an id count once, with their least vector.
Vectors of different length don't meet. Ties go to the smaller id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import stage, table

SHARD = 8192
BLOCK = 2048
LEAF = 128
LIMIT = 1 << 28


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if any is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return F.when(finite & (F.size(vector) > 0), whole)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b: in doubles where no sum can pass 2^53, else in integers."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class BallTree:
    """Distinct vectors in leaf order, the ids of each, and the leaves' places, centres and radii."""

    vectors: np.ndarray
    ids: list[np.ndarray]
    bounds: np.ndarray
    centres: np.ndarray
    radii: np.ndarray


def leaf_order(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """Order of the rows by leaf, and where leaves end. A node is halved along the line from the point farthest from its
    centre to the point farthest from that."""
    order, ends, todo = np.arange(len(vectors)), [], [(0, len(vectors))]
    while todo:
        low, high = todo.pop()
        if high - low <= leaf:
            ends.append(high)
            continue
        mine = vectors[order[low:high]]
        far = mine[((mine - mine.mean(0)) ** 2).sum(1).argmax()]
        line = mine[((mine - far) ** 2).sum(1).argmax()] - far
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(mine @ line, middle)]
        todo += [(low + middle, high), (low, low + middle)]
    return order, sorted(ends)


def _order_shard(k: int):
    def build(shard: pa.Table) -> pa.Table:
        """The shard's distinct vectors with their k + 1 least ids, numbered by leaf."""
        vectors, ids = _matrix(shard["v"]), shard["vec_id"].to_numpy()
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.ravel()
        by = np.lexsort((ids, which))
        first = np.searchsorted(which[by], np.arange(len(distinct) + 1))
        order, ends = leaf_order(distinct)
        leaf = np.searchsorted(ends, np.arange(len(order)), "right")
        keep = [ids[by[first[i] : min(first[i + 1], first[i] + k + 1)]] for i in order.tolist()]
        n = len(order)
        return pa.table({"dim": pa.array(np.full(n, vectors.shape[1], np.int32)), "shard": shard["shard"].slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))),
                         "leaf": pa.array(leaf.astype(np.int32)), "v": pa.array(list(distinct[order].astype(np.int32)), pa.list_(pa.int32())), "ids": pa.array(keep, pa.list_(pa.int64()))})

    return build


def load_tree(shard: pa.Table) -> BallTree:
    leaf = shard["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    vectors, leaf = _matrix(shard["v"])[order], leaf[order]
    ids = shard["ids"].to_pylist()
    bounds = np.searchsorted(leaf, np.arange(leaf[-1] + 2))
    size = np.diff(bounds)
    centres = np.add.reduceat(vectors, bounds[:-1], axis=0) / size[:, None]
    radii = np.sqrt(np.maximum.reduceat(((vectors - np.repeat(centres, size, axis=0)) ** 2).sum(1), bounds[:-1]))
    return BallTree(vectors, [np.array(ids[i], np.int64) for i in order.tolist()], bounds, centres, radii)


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, leaves: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best k of each query in the tree, without its own id and without scores below ``floor``.

    Leaves are visited by falling upper bound, all queries in step: those whose n-th leaf is the same multiply with it
    together. A query ends when the next bound is below the k-th score it has; with ``leaves`` it ends after so many."""
    upper = queries @ tree.centres.T + np.sqrt((queries**2).sum(1))[:, None] * tree.radii
    upper += 1e-6 * (1 + np.abs(upper))
    visit = np.argsort(-upper, axis=1, kind="stable")
    # Above 2^53 a double may round a score up; the next lower one never passes it.
    kth, live = np.where(np.abs(floor) < 2.0**53, floor, np.nextafter(floor.astype(np.float64), -np.inf)), np.arange(len(queries))
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
    for step in range(min(len(tree.radii), leaves or len(tree.radii))):
        live = live[upper[live, visit[live, step]] >= kth[live]]
        if not len(live):
            break
        leaf_of = visit[live, step]
        for leaf in np.unique(leaf_of).tolist():
            mine = live[leaf_of == leaf]
            low, high = tree.bounds[leaf], tree.bounds[leaf + 1]
            score = _products(queries[mine], tree.vectors[low:high])
            hit, at = np.nonzero(score >= kth[mine][:, None])
            if high - low > k:  # only a row's k + 1 best entries, and ties with the last of them, can be answers
                least = np.partition(score, high - low - k - 1, axis=1)[:, high - low - k - 1]
                good = score[hit, at] >= least[hit]
                hit, at = hit[good], at[good]
            touched = set()
            for q, i, s in zip(mine[hit].tolist(), at.tolist(), score[hit, at].tolist()):
                found[q] += [(-int(s), int(x)) for x in tree.ids[low + i] if x != own[q]]
                touched.add(q)
            for q in touched:
                found[q] = sorted(found[q])[:k]
                if len(found[q]) == k:
                    last = float(-found[q][-1][0])
                    kth[q] = max(kth[q], last if abs(last) < 2.0**53 else np.nextafter(last, -np.inf))
    size = [len(f) for f in found]
    flat = [x for f in found for x in f]
    return np.repeat(np.arange(len(queries)), size), np.array([x[1] for x in flat], np.int64), np.array([-x[0] for x in flat], np.int64)


def _search_group(k: int, leaves: int | None):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        own = block["query_id"].to_numpy()
        floor = block["floor"].to_numpy().astype(np.float64)
        row, ids, score = search(load_tree(shard), _matrix(block["q"]), own, k, floor, leaves)
        return pa.table({"query_id": pa.array(own[row]), "vec_id": pa.array(ids), "score": pa.array(score)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: groups hold at most k rows a shard, and Spark cuts them per task before the shuffle."""
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank")
    return ranked.where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row for which ``is_query`` holds, among all other rows."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(F.col(embedding), scale).alias("v"), is_query.alias("asks"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    rows = stage(rows.withColumn("dim", F.size("v")), "vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // BLOCK))
    dealt = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "v")
    trees = stage(dealt.groupBy("dim", "shard").applyInArrow(_order_shard(k), "dim int, shard long, leaf int, v array<int>, ids array<long>"), "trees")
    asks = rows.where("asks").select("dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    every_block = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def round_of(queries: DataFrame, leaves: int | None) -> DataFrame:
        every_shard = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
        keys = ("dim", "shard", "block")
        met = every_block.groupBy(*keys).cogroup(every_shard.groupBy(*keys)).applyInArrow(_search_group(k, leaves), "query_id long, vec_id long, score long")
        return stage(_best(met, k), "found")

    first = round_of(asks.withColumn("floor", F.lit(-(2**62)).cast("long")), 1)
    shared = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    known = asks.join(shared, "query_id", "left").select(*asks.columns, F.coalesce("kth", F.lit(-(2**62))).cast("long").alias("floor"))
    return round_of(known, None).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
