"""Tokenise documents and pack them into sequences: bound-certified repacking.

A document is its token ids and an end id; one longer than a sequence is cut into whole sequences and a rest. Pieces are
dealt into groups of about ``GROUP`` by Spark and each group is packed by best-fit decreasing. Dual-feasible functions give a
lower bound on the group's sequences. A group that meets its bound is certified and settled, but for its emptiest sequence; a
group with a gap gives up its emptiest sequences too. What was given up by ``MERGE`` groups is packed together in the next
round, and the packing is taken if it needs fewer sequences. Rounds end when one group is left. A task never holds more than one
group, whatever the table's size.

Null and empty texts are one piece of the end id alone. Null and repeated doc_ids are packed row by row. Empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import stage, table
from semaspark.llm.words import SMALL_CHUNK, Texts, chunks, gather

CAPACITY = 4096
END_ID = 1
GROUP = 32768
MERGE = 8
GIVE_UP = 8  # a group with a gap gives up one in so many sequences
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
# A letter run always ends before these, so what follows is encoded on its own. Apostrophes belong to contractions and < | >
# to the names of special tokens; they do not cut.
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?%$&*#"]] = True


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts. The vocabulary drops white space and case, so parts of words are encoded once and looked up by hash;
    at most ``MOST`` of them are remembered."""

    MOST = 1_000_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        out: list[list[int] | np.ndarray] = [[]] * len(words)
        if plain:
            joined = self.tokenizer.encode(" ".join(words[i] for i in plain), add_special_tokens=False)
            of = np.array(joined.word_ids, np.int64)
            if len(of) and of[-1] == len(plain) - 1:  # each word is one run of letters
                parts = np.split(np.array(joined.ids, np.uint32), np.searchsorted(of, np.arange(1, len(plain))))
            else:
                parts = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in plain], add_special_tokens=False)]
            for i, ids in zip(plain, parts):
                out[i] = ids
        rest = [i for i, w in enumerate(words) if not w.isalpha()]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return np.concatenate([np.asarray(x, np.uint32) for x in out]), np.array([len(x) for x in out], np.int64)

    def _learn(self, part: Texts, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.MOST:
            self.forget()
        ids, size = self._encode(gather(part.data, start, end).tobytes().decode("utf-8", "replace").split("\n")[:-1])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.concatenate(([0], np.cumsum(size)[:-1]))
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunk's rows one after the other, each row ended by END_ID; where rows begin and end in them."""
        data = part.data
        after_letter = np.concatenate(([False], _LETTER[data[:-1]])) if len(data) else np.zeros(0, bool)
        start, end = part.spans(_SPACE[data], after_letter & _CUT[data])
        row = part.row_of(start)
        keys, first, which = np.unique(part.hashes(start, end, lower=True), return_index=True, return_inverse=True)
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + len(keys) > self.MOST:
                self.forget()
                known[:] = False
            self._learn(part, start[first[~known]], end[first[~known]], keys[~known])
            at, _ = self._find(keys)
        size, begin = self.size[at][which], self.at[at][which]
        per_row = np.bincount(row, size, part.rows).astype(np.int64) + 1
        bounds = np.concatenate(([0], np.cumsum(per_row)))
        out = np.full(bounds[-1], END_ID, np.uint32)
        upto = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin, size)
        out[np.arange(upto[-1]) + np.repeat(row, size)] = self.ids[source]
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """Chunks of a batch with what ``encode`` gives: small ones, as encoding keeps some hundred bytes a byte and workers keep what they had."""
    for part in chunks(texts, SMALL_CHUNK):
        yield part, *encoder.encode(part)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """PIECES: a row per piece of each document."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for batch in batches:
            rows, start, end, crc = [], [], [], []
            for part, ids, bounds in encoded(_encoders[path], batch.column(1)):
                raw = memoryview(ids.astype("<u4")).cast("B")
                count = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(part.rows), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                low = bounds[row] + nth * capacity
                high = np.minimum(low + capacity, bounds[row + 1])
                rows.append(row + part.first), start.append(nth * capacity), end.append(nth * capacity + high - low)
                crc.append(np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), high.tolist())), np.int64, len(low)))
            if rows:
                s, e = np.concatenate(start), np.concatenate(end)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array((s // capacity).astype(np.int32)), pa.array(s), pa.array(e - s), pa.array(np.concatenate(crc))],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tokenise, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that dual-feasible functions show: no packing has fewer bins. Two families, over counts by size: big items
    count whole and small ones nothing; and sizes rounded down to k-ths of a bin unless they are exact ones."""
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1)
    count, weight = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * x)))
    e = np.arange(capacity // 2 + 1)
    big = count[-1] - count[capacity - e + 1]
    middle = weight[capacity - e + 1] - weight[e]
    best = int((-(-(big * capacity + middle) // capacity)).max())
    for k in range(1, 21):
        parts = (k + 1) * x
        total = int((n * np.where(parts % capacity == 0, k * x, parts // capacity * capacity)).sum())
        best = max(best, -(-total // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds. Bins are kept by free space; a bit set finds the tightest."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, fill = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += size
        left = space - size
        by_space[left].append(b)
        if left:
            spaces |= 1 << left
    return bin_of, offset, np.array(fill, np.int64)


ROUND = PIECES + ", grp long, sequence_id long, offset long, settled boolean"


def _pack(round_no: int, capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        size, old = group["length"].to_numpy(), group["sequence_id"].to_numpy()
        grp = int(group["grp"][0].as_py())
        bin_of, offset, fill = best_fit_decreasing(size, capacity)
        names, old_bin = np.unique(old, return_inverse=True)
        if round_no and len(names) <= len(fill):  # what was given up was not worse
            bin_of, offset, fill = old_bin, group["offset"].to_numpy(), np.bincount(old_bin, size, len(names)).astype(np.int64)
            ids = names
        else:
            ids = (np.int64(round_no + 1) << 56) + (np.int64(grp) << 24) + np.arange(len(fill))
        gap = len(fill) - lower_bound(size, capacity)
        give = 1 if gap <= 0 else max(1, len(fill) // GIVE_UP)
        emptiest = np.argsort(fill, kind="stable")[:give]
        settled = np.ones(len(fill), bool)
        settled[emptiest[fill[emptiest] < capacity]] = False
        out = group.drop_columns(["grp", "sequence_id", "offset", "settled"])
        more = (pa.array(np.full(len(size), grp // MERGE, np.int64)), pa.array(ids[bin_of]), pa.array(offset), pa.array(settled[bin_of]))
        for name, column in zip(("grp", "sequence_id", "offset", "settled"), more):
            out = out.append_column(name, column)
        return out

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """PIECES with sequence_id and offset."""
    # The row number deals equal rows, too, evenly over the groups; it is written before it is used.
    items = stage(items.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    whole = items.where(F.col("length") == capacity).select(*(c for c in items.columns if c != "nth"), F.col("nth").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))
    todo = rest.select(*(c for c in items.columns if c != "nth"), F.pmod(F.xxhash64("nth"), F.lit(groups)).alias("grp"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("settled"))
    done, round_no = [whole], 0
    while True:
        packed = stage(todo.groupBy("grp").applyInArrow(_pack(round_no, capacity), ROUND), "packed")
        columns = [c for c in packed.columns if c not in ("grp", "settled")]
        if groups == 1:
            done.append(packed.select(*columns))
            break
        done.append(packed.where("settled").select(*columns))
        todo, groups, round_no = packed.where("not settled"), -(-groups // MERGE), round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(pieces(docs, path or vocabulary(), doc_id, text, capacity), capacity, group)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
