"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

A token is a word in lower case A-Z; every text ends with one end token. A word belongs to one of 32 classes by its
last bytes and to one of 32 slots of its class by its hash:

    P(word | context) = P(class | context) P(slot | class, context) P(word | slot).

The first two are softmaxes over hashed features: the word before, the word before that (skip), and the classes of the
words up to four places back; for slots, these together with the class. The last is the smoothed share of the
word among the training tokens of its slot, (c + 1) / (N_slot + V_slot + 1), so unknown words have their part.

Training. Spark counts all training tokens. Weights start from those counts and are then trained in ``ROUNDS`` rounds,
each over its share of the training documents: a task runs gradient steps in numpy batches over all its documents, from the
weights of the round before, and the tasks' changes are averaged per feature row, weighted by how often a task met
the row. The weights have a fixed size (``CLASS_ROWS + SLOT_ROWS`` rows of 32).

Scoring needs the count of every token. Those of the ``HEAD`` most frequent tokens go to the tasks; the others, rare by
construction, are joined by token and summed per text, so no part depends on the size of the vocabulary.

Null texts are empty: one end token. Rows with null ids count as id ''. Without training tokens N and V are 0 and classes and
slots are even. Repeated rows are scored row by row. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.frames import stage, table
from semaspark.llm.words import Texts, chunks, mix

WIDTH = 32
WORD_ROWS = 4096
PAIR_ROWS = WIDTH * WIDTH
CLASS_ROWS = 2 * WORD_ROWS + 2 * PAIR_ROWS + 1
SLOT_HASHED = 8192
SLOT_ROWS = SLOT_HASHED + 3 * PAIR_ROWS + WIDTH
ROUNDS = 2
BATCH = 4096
RATE = 0.3
HEAD = 1 << 18
MERGE = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = mix(np.array([0xE0D], np.uint64))[0]


@dataclass
class Tokens:
    """Tokens of a chunk in order: hash, slot (class * WIDTH + slot in it), row and place in the row."""

    token: np.ndarray
    slot: np.ndarray
    row: np.ndarray
    place: np.ndarray


def tokens(part: Texts) -> Tokens:
    start, end, word_row = part.words()
    key = part.hashes(start, end, lower=True)
    low = _LOWER[part.data]
    last = np.zeros(len(start), np.uint64)
    for back in (1, 2, 3):
        at = end - back
        last = last * np.uint64(257) + np.where(at >= start, low[np.maximum(at, 0)] if len(low) else 0, 0).astype(np.uint64)
    group = (mix(last) % np.uint64(WIDTH)).astype(np.int64)
    n_words = np.bincount(word_row, minlength=part.rows)
    n = len(start) + part.rows
    at = np.arange(len(start)) + word_row
    out = Tokens(np.full(n, _END), np.zeros(n, np.int64), np.repeat(np.arange(part.rows), n_words + 1), np.empty(0))
    out.token[at] = key
    out.slot[at] = group * WIDTH + ((key >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n_words + 1)))[:-1]
    out.place = np.arange(n) - np.repeat(first, n_words + 1)
    return out


def context(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the class softmax and of the slot softmax for every token."""

    def back(values: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[k:] = values[: len(values) - k]
        out[t.place < k] = 0
        return out

    group = t.slot // WIDTH
    one, two = back(t.token, 1), back(t.token, 2)
    c1, c2, c3, c4 = (back(group, k) for k in (1, 2, 3, 4))
    n = np.uint64(WORD_ROWS)
    classes = np.stack((
        (one % n).astype(np.int64), WORD_ROWS + (two % n).astype(np.int64), 2 * WORD_ROWS + c1 * WIDTH + c2,
        2 * WORD_ROWS + PAIR_ROWS + c3 * WIDTH + c4, np.full(len(group), CLASS_ROWS - 1)))
    hashed = (mix(one + group.astype(np.uint64)) % np.uint64(SLOT_HASHED)).astype(np.int64)
    slots = np.stack((hashed, *(SLOT_HASHED + i * PAIR_ROWS + group * WIDTH + c for i, c in enumerate((c1, c2, c3))), SLOT_ROWS - WIDTH + group))
    return classes, slots


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probabilities, one line per token: the summed feature rows, normalised."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _step(weights: np.ndarray, square: np.ndarray, met: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
    """One gradient step on a batch; each row's step shrinks with the gradients it has had."""
    wrong = np.exp(log_softmax(weights, rows))
    wrong[np.arange(len(wanted)), wanted] -= 1
    for r in rows:
        order = np.argsort(r.astype(np.uint16), kind="stable")
        ranked = r[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        at, grad = ranked[first], np.add.reduceat(wrong[order], first, axis=0)
        square[at] += (grad**2).mean(1)
        weights[at] -= (RATE * grad) / np.sqrt(square[at] + 1.0)[:, None]
        met[at] += np.diff(np.append(first, len(r)))


@dataclass
class Model:
    classes: np.ndarray
    slots: np.ndarray
    slot_total: np.ndarray  # N_slot + V_slot + 1

    def score(self, t: Tokens) -> np.ndarray:
        """log10 P(token's slot | context) less log10 of the slot's total: what is left of P is its count plus one."""
        out = np.empty(len(t.token))
        by_class, by_slot = context(t)
        for a in range(0, len(out), BATCH):
            some, at = slice(a, a + BATCH), np.arange(min(BATCH, len(out) - a))
            of = t.slot[some]
            natural = log_softmax(self.classes, by_class[:, some])[at, of // WIDTH] + log_softmax(self.slots, by_slot[:, some])[at, of % WIDTH]
            out[some] = natural / np.log(10) - np.log10(self.slot_total[of])
        return out


def initial(slot_n: np.ndarray, slot_v: np.ndarray) -> Model:
    """The unigram model: the bias rows hold the logarithms of the counts."""
    share = slot_n.reshape(WIDTH, WIDTH) + 0.5
    model = Model(np.zeros((CLASS_ROWS, WIDTH), np.float32), np.zeros((SLOT_ROWS, WIDTH), np.float32), slot_n + slot_v + 1.0)
    model.classes[-1] = np.log(share.sum(1))
    model.slots[SLOT_ROWS - WIDTH :] = np.log(share)
    return model


def count_tokens(texts: DataFrame) -> DataFrame:
    """token, slot, n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tokens(p) for p in chunks(batch.column(0))]
            if not parts:
                continue
            some = [np.unique(t.token, return_index=True, return_counts=True) for t in parts]
            key = np.concatenate([s[0] for s in some])
            slot = np.concatenate([t.slot[s[1]] for t, s in zip(parts, some)])
            n = np.concatenate([s[2] for s in some])
            one, first, which = np.unique(key, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(slot[first].astype(np.int16)), pa.array(np.bincount(which, n).astype(np.int64))], ["token", "slot", "n"])

    return texts.mapInArrow(count, "token long, slot short, n long").groupBy("token", "slot").agg(F.sum("n").alias("n"))


CHANGE = "task long, side int, at int, n array<float>, change array<float>"
BLOCK = 512


def _changes(texts: DataFrame, sent) -> DataFrame:
    """What each task would change, weighted by how often it met each row, in blocks of rows."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin: Model = sent.value
        sides = [[w.copy(), np.zeros(len(w), np.float32), np.zeros(len(w), np.float32)] for w in (begin.classes, begin.slots)]
        for batch in batches:
            for part in chunks(batch.column(0)):
                t = tokens(part)
                rows = context(t)
                for a in range(0, len(t.token), BATCH):
                    some = slice(a, a + BATCH)
                    for side, r, wanted in zip(sides, rows, (t.slot[some] // WIDTH, t.slot[some] % WIDTH)):
                        _step(*side, r[:, some], wanted)
        task = TaskContext.get().partitionId()
        for i, ((w, _, met), old) in enumerate(zip(sides, (begin.classes, begin.slots))):
            change = (w - old) * met[:, None]
            for at in range(0, len(w), BLOCK):
                if met[at : at + BLOCK].any():
                    lists = [pa.array([x], pa.list_(pa.float32())) for x in (met[at : at + BLOCK], change[at : at + BLOCK].ravel())]
                    yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([i], pa.int32()), pa.array([at], pa.int32()), *lists], ["task", "side", "at", "n", "change"])

    return texts.mapInArrow(learn, CHANGE)


def _sum_changes(group: pa.Table) -> pa.Table:
    sums = [np.sum([x.values.to_numpy() for x in group[c]], axis=0, dtype=np.float64).astype(np.float32) for c in ("n", "change")]
    return pa.table([pa.array([group["task"][0].as_py() // MERGE], pa.int64()), group["side"].slice(0, 1), group["at"].slice(0, 1), *(pa.array([s], pa.list_(pa.float32())) for s in sums)], names=["task", "side", "at", "n", "change"])


def train_round(texts: DataFrame, model: Model) -> Model:
    changes = stage(_changes(texts, texts.sparkSession.sparkContext.broadcast(model)), "changes")
    tasks = (changes.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 0:  # at most MERGE rows a group; the last sum has one row per block
        grouped = changes.groupBy(F.floor(F.col("task") / MERGE).alias("part"), "side", "at").applyInArrow(_sum_changes, CHANGE)
        tasks = tasks // MERGE if tasks > MERGE else 0
        changes = stage(grouped, "changes") if tasks else grouped
    out = Model(model.classes.copy(), model.slots.copy(), model.slot_total)
    for r in changes.collect():
        met, w = np.array(r["n"], np.float32), (out.classes, out.slots)[r["side"]]
        w[r["at"] : r["at"] + len(met)] += np.array(r["change"], np.float32).reshape(-1, WIDTH) / np.maximum(met, 1)[:, None]
    return out


def fit(training: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame, int, int]:
    """The model, the counts of all training tokens, and N and V. ``training`` has the texts to learn from."""
    texts = training.select(F.col(text).alias("text"))
    counts = stage(count_tokens(texts), "counts")
    stats = counts.groupBy("slot").agg(F.sum("n"), F.count("*")).collect()  # at most WIDTH * WIDTH rows
    slot_n, slot_v = np.zeros(WIDTH * WIDTH), np.zeros(WIDTH * WIDTH)
    for slot, n, v in stats:
        slot_n[slot], slot_v[slot] = n, v
    model = initial(slot_n, slot_v)
    for i in range(rounds):
        model = train_round(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i), model)
    return model, counts, int(slot_n.sum()), int(slot_v.sum())


SCORED = "n_tokens long, n_head long, log_head double, log_model double, tail array<long>"


def _score_parts(text: Column, sent) -> Column:
    @F.arrow_udf(SCORED)
    def scored(texts: pa.Array) -> pa.Array:
        model, keys, logs = sent.value
        columns: list[list[np.ndarray]] = [[], [], [], []]
        tails: list[np.ndarray] = []
        tail_n: list[np.ndarray] = []
        for part in chunks(texts):
            t = tokens(part)
            at = np.minimum(np.searchsorted(keys, t.token), max(len(keys) - 1, 0))
            head = keys[at] == t.token if len(keys) else np.zeros(len(t.token), bool)
            rows = part.rows
            columns[0].append(np.bincount(t.row, minlength=rows))
            columns[1].append(np.bincount(t.row[head], minlength=rows))
            columns[2].append(np.bincount(t.row[head], logs[at[head]], rows) if head.any() else np.zeros(rows))
            columns[3].append(np.bincount(t.row, model.score(t), rows))
            tails.append(t.token[~head].view(np.int64))
            tail_n.append(np.bincount(t.row[~head], minlength=rows))
        flat = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        ends = np.concatenate(([0], np.cumsum(np.concatenate(tail_n)) if tail_n else [])).astype(np.int32)
        tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tails) if tails else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2]), pa.array(flat[3]), tail], [x.split()[0] for x in SCORED.split(", ")])

    return scored(text)


def score(docs: DataFrame, model: Model, counts: DataFrame, n: int, v: int, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both log10), one row per row of ``docs``."""
    top = counts.orderBy(F.desc("n"), "token").limit(head).select("token", "n").toArrow()
    key, c = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(key)
    sent = docs.sparkSession.sparkContext.broadcast((model, key[order], np.log10(c[order] + 1.0)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _score_parts(F.col(text), sent).alias("s"))
    # The row number tells equal rows apart; it is written before it is used.
    rows = stage(rows.select("doc_id", "s.*", F.monotonically_increasing_id().alias("nth")), "scored")
    tail = rows.select("nth", F.explode("tail").alias("token")).join(counts.select("token", "n"), "token")
    tail = tail.groupBy("nth").agg(F.count("*").alias("n_tail"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_tail"))
    joined = rows.drop("tail").join(tail, "nth", "left")
    logs = F.col("log_head") + F.coalesce("log_tail", F.lit(0.0))
    return joined.select("doc_id", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
                         (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (logs + F.col("log_model")).alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts, n, v = fit(docs.where(~held_out()))
    out = score(docs, model, counts, n, v)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
