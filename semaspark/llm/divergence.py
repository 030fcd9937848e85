"""How far the sources of a language differ in the terms they use.

Terms are counted by length. In a task, terms of up to 8 bytes are packed into one uint64 and those of up to 16
into two, radix-sorted by 16-bit digits and counted by runs; each greater length is a bucket of its own, sorted
by bytes. What a chunk of texts counts is summed by Spark per (lang, source, term), with the documents it
occurs in. A language keeps the terms of at least ``LEAST_DOCS`` of its documents.

With V kept terms and N occurrences of them in a group, a group gives a term that it has c times the share
p = 1 + floor(10^9 (c + 2) / (N + 2 V)). Two groups differ in a term by floor((p - q)^2 / (p + q)). Part ``pair`` sums
that over all kept terms, for each two sources of a language; part ``term`` has, for each source, the ten terms in
which it exceeds its language most. Kept terms are dealt over blocks by hash; a block has the counts of its terms in
all sources of the language as a matrix, so a frequent language is many blocks and a pair one row a block. The
sources of a language are one list, for the result has a row for each two of them.

Null text, lang and source are read as ''. A source without terms, or a language that keeps none, still has its
pairs, with the shares that the formulas give (0 if V is 0). Repeated rows and ids are documents of their own. Ties
in rank go by UTF-8 bytes. Empty tables give no rows, other columns are not read, and texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaspark.llm.frames import salted_join, stage, table
from semaspark.llm.words import chunks

LEAST_DOCS = 10
TOP = 10
BLOCK_TERMS = 1024
CELLS = 1 << 21  # cells of a matrix that are divided at once
ONE = 10**9
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTS = "lang string, source string, term binary, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by ``words``, least significant word first: one counting pass for each 16-bit
    digit that is not the same in all rows."""
    order = np.arange(len(words[0]))
    for word in words:
        spread = np.bitwise_or.reduce(word ^ word[0]) if len(word) else np.uint64(0)
        for shift in (0, 16, 32, 48):
            if (int(spread) >> shift) & 0xFFFF:
                order = order[np.argsort((word >> np.uint64(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to 8 bytes at each ``start`` as one uint64 that sorts as the bytes do; ``data`` has 8 bytes to spare."""
    at = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), 0, (1,))[start].astype(np.uint64)
    gap = (8 * (8 - np.clip(size, 0, 8))).astype(np.uint64)
    return np.where(size > 0, (at >> np.minimum(gap, np.uint64(63))) << np.minimum(gap, np.uint64(63)), np.uint64(0))


def _runs(same: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and distinct rows of each run; ``same``: equal to the place before."""
    first = np.flatnonzero(~same)
    fresh = ~same
    fresh[1:] |= rows[1:] != rows[:-1]
    return first, np.diff(np.append(first, len(same))), np.add.reduceat(fresh.astype(np.int64), first)


def _same(*sorted_keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_keys[0]), bool)
    out[0] = False
    for key in sorted_keys:
        out[1:] &= key[1:] == key[:-1]
    return out


def term_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Terms with the group, occurrences and rows of each, from spans of bytes in the order of their rows."""
    data = np.concatenate((data, np.zeros(16, np.uint8)))
    for at in (np.flatnonzero(size <= 8), np.flatnonzero((size > 8) & (size <= 16))):
        if not len(at):
            continue
        high = packed(data, start[at], size[at])
        low = packed(data, start[at] + 8, size[at] - 8)
        words = [high] if size[at[0]] <= 8 else [low, high]
        order = radix_order([group[at].astype(np.uint64), *words])
        first, n, docs = _runs(_same(group[at][order], *(w[order] for w in words)), rows[at][order])
        found = order[first]
        text = np.stack([w[found] for w in reversed(words)], axis=1).astype(">u8").view(f"S{8 * len(words)}").ravel().tolist()
        yield text, group[at][found], n, docs
    long = np.flatnonzero(size > 16)
    by_size = long[np.argsort(size[long], kind="stable")]
    for at in np.split(by_size, np.flatnonzero(np.diff(size[by_size])) + 1):
        if not len(at):
            continue
        text = data[start[at][:, None] + np.arange(size[at[0]])].view(f"S{size[at[0]]}").ravel()
        order = np.argsort(group[at], kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        first, n, docs = _runs(_same(group[at][order], text[order]), rows[at][order])
        yield text[order[first]].tolist(), group[at][order[first]], n, docs


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        for c in chunks(batch.column(2)):
            start, end = c.spans(_GAP[c.data])
            rows = c.row_of(start)
            for text, of, n, docs in term_runs(_LOWER[c.data], start, end - start, group[c.first + rows], rows):
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))),
                     pa.array(text, pa.binary()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, its occurrences and its documents there; ``docs`` has lang, source and text without nulls."""
    found = docs.select("lang", "source", "text").mapInArrow(_count_batches, COUNTS).withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), three decimal digits at a time: nothing leaves 64 bits below totals of 9e15."""
    left = count + 2
    out = left // total
    left = left - out * total
    for _ in range(3):
        digit = left * 1000
        step = digit // total
        out = out * 1000 + step
        left = digit - step * total
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: the sum over its terms for each two sources, the first of them less, and its best terms."""
    for batch in batches:
        for row in range(batch.num_rows):
            lang = batch.column("lang")[row].as_py()
            groups, terms, v = batch.column("groups")[row].values, batch.column("terms")[row].values, batch.column("v")[row].as_py()
            source, total = groups.field("source"), groups.field("total").to_numpy()
            s, t = len(source), len(terms)
            # Values of a slice ignore its offset, so positions are taken from the offsets of the lists.
            cells = terms.field("cells")
            sizes = pc.list_value_length(cells).to_numpy().astype(np.int64) if t else np.zeros(0, np.int64)
            flat = cells.flatten()
            at = pc.index_in(flat.field("source"), value_set=source).to_numpy().astype(np.int64) if t else np.zeros(0, np.int64)
            n, of = flat.field("n").to_numpy(), np.repeat(np.arange(t), sizes)
            sums, best = np.zeros((s, s), np.int64), [[] for _ in range(s)]
            step = max(1, CELLS // s)
            for low in range(0, t, step):
                high = min(t, low + step)
                here = (of >= low) & (of < high)
                count = np.zeros((s, high - low), np.int64)
                count[at[here], of[here] - low] = n[here]
                p = shares(count, (total + 2 * v)[:, None])
                q = shares(count.sum(axis=0), total.sum() + 2 * v)
                for i in range(s):
                    sums[i, i + 1 :] += differences(p[i], p[i + 1 :]).sum(axis=1)
                    over = np.flatnonzero((count[i] > 0) & (p[i] > q))
                    f = differences(p[i][over], q[over])
                    first = np.argsort(-f, kind="stable")[:TOP]
                    best[i] += [(-int(f[k]), int(low + over[k])) for k in first]
                    best[i] = sorted(best[i])[:TOP]
            a, b = np.triu_indices(s, 1)
            if len(a):
                yield _rows(lang, source.take(pa.array(a)), "pair", source.take(pa.array(b)), sums[a, b])
            who = np.array([i for i in range(s) for _ in best[i]], np.int64)
            if len(who):
                what = [x for i in range(s) for x in best[i]]
                yield _rows(lang, source.take(pa.array(who)), "term", terms.field("term").take(pa.array([k for _, k in what])), np.array([-f for f, _ in what], np.int64))


def _rows(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source.cast(pa.string()), pa.array([part] * n, pa.string()), item.cast(pa.string()), pa.array(value)], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: other sources by difference, and the first terms of each source."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = stage(count_terms(read), "terms")
    cells = F.collect_list(F.struct("source", "n")).alias("cells")
    kept = stage(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), cells).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    groups = stage(read.select("lang", "source").distinct(), "groups")
    each = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    sized = groups.join(each, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_lang = sized.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    of_lang = stage(of_lang.join(vocabulary, "lang", "left").select("lang", "groups", F.coalesce("v", F.lit(0)).cast("long").alias("v")), "languages")
    blocks = kept.count() // BLOCK_TERMS + 1
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("term", "cells"))).alias("terms"))
    # One block without terms for each language: its pairs are there even if it keeps nothing.
    none = of_lang.select("lang", F.lit(-1).cast("long").alias("block"), F.array().cast(dealt.schema["terms"].dataType).alias("terms"))
    compared = salted_join(dealt.unionByName(none), of_lang, "lang", F.col("block")).select("lang", "terms", "groups", "v")
    parts = stage(compared.mapInArrow(_compare_blocks, PARTS), "parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = sums.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = parts.where("part = 'term'")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def _share(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total}))"


def _difference(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) // ({p} + {q}))"


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT z.lang, any_value(coalesce(v.v, 0)) AS v, sum(z.n) AS n FROM z LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY lang) v USING (lang) GROUP BY z.lang),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n, {_share("coalesce(c.n, 0)", "z.n + 2 * l.v")} AS p
  FROM z JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
q AS (SELECT c.lang, c.term, {_share("sum(c.n)", "any_value(l.n + 2 * l.v)")} AS q FROM c JOIN l USING (lang) GROUP BY c.lang, c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_difference("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, {_difference("p.p", "q.q")} FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank FROM x
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= 10
"""
