"""A modified Kneser-Ney model of the characters inside words, one per language, counted by Spark.

Characters fold to 64 symbols by rule, so a language has at most 64^3 trigrams. Words are scored from
word start to word end, so a batch scores each distinct word once. At most ``MAX_LANGS`` languages have a
model of their own; all others share one. Those two bounds hold the model, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspark.llm.words import SMALL_CHUNK, Texts, chunks, gather, mix

SYMBOLS = 64
MAX_LANGS = 63
GRAMS = SYMBOLS**3
_table: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Symbol of each code point below U+10000. 0 is the word's edge, 1 to 26 Latin letters of either case,
    27 digits, 28 to 30 ASCII punctuation, 31 to 62 other letters by their lower case, 63 the rest."""
    if not _table:
        out = np.full(65536, 63, np.uint8)
        for cp in range(65536):
            c = chr(cp)
            low = c.lower()
            if "a" <= low <= "z" and len(low) == 1:
                out[cp] = ord(low) - 96
            elif "0" <= c <= "9":
                out[cp] = 27
            elif cp < 128:
                out[cp] = 28 if c in ".,;:!?" else 29 if c in "'\"-()[]{}/" else 30
            elif c.isalpha():
                out[cp] = 31 + ord(low[0]) % 32
        _table.append(out)
    return _table[0]


def word_symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram number of each character of each word, its end included, and which word it belongs to."""
    points = np.frombuffer(gather(data, start, end).tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    edge = points == 10
    symbol = np.where(edge, 0, symbol_table()[np.minimum(points, 65535)]).astype(np.int32)
    one = np.concatenate(([0], symbol[:-1]))
    two = np.concatenate(([0, 0], symbol[:-2]))[: len(symbol)]
    after_edge = np.concatenate(([True], edge[:-1]))[: len(symbol)]
    two[after_edge] = 0
    return (two * SYMBOLS + one) * SYMBOLS + symbol, np.cumsum(edge) - edge


def distinct_words(part: Texts, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of one word of each distinct (word, group of its row), its group, how often it is there,
    the row of every word and which distinct word it is."""
    start, end, row = part.words()
    of = group[row]
    _, first, which, count = np.unique(mix(part.hashes(start, end) + of.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
    return start[first], end[first], of[first], count, row, which


def _codes(langs: pa.Array, slots: dict[str, int]) -> np.ndarray:
    return np.array([slots.get(x, 0) if x is not None else 0 for x in langs.to_pylist()], np.int64)


def language_slots(docs: DataFrame, lang: str) -> dict[str, int]:
    """The languages with a model of their own: the most frequent, ties by name. All others have slot 0."""
    top = docs.where(F.col(lang).isNotNull()).groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGS).collect()
    return {r[0]: i + 1 for i, r in enumerate(top)}


def count_grams(docs: DataFrame, text: str, lang: str, slots: dict[str, int]) -> DataFrame:
    """slot, gram, n over all whole texts: summed per task in an array, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = _codes(batch.column(1), slots)
            for part in chunks(batch.column(0), SMALL_CHUNK):
                start, end, of, n, _, _ = distinct_words(part, codes[part.first : part.last])
                gram, word = word_symbols(part.data, start, end)
                for slot in np.unique(of):
                    mine = of[word] == slot
                    sums[slot] = sums.get(slot, 0) + np.bincount(gram[mine], n[word[mine]], GRAMS)
        for slot, total in sums.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), slot, np.int32)), pa.array(seen.astype(np.int32)), pa.array(total[seen].astype(np.int64))], ["slot", "gram", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "slot int, gram int, n long")
    return rows.groupBy("slot", "gram").agg(F.sum("n").alias("n"))


@dataclass
class CharModel:
    """Sorted trigrams and bigrams with their log10 probabilities and log10 back-off weights."""

    tri: np.ndarray
    tri_p: np.ndarray
    pair: np.ndarray
    pair_p: np.ndarray
    context: np.ndarray
    context_b: np.ndarray
    one_p: np.ndarray
    one_b: np.ndarray

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each trigram after the first two."""
        out, back = np.empty(len(gram)), gram // SYMBOLS
        at, seen = _find(self.tri, gram)
        out[seen] = self.tri_p[at[seen]]
        rest = np.flatnonzero(~seen)
        at, known = _find(self.context, back[rest])
        lost = np.where(known, self.context_b[at], 0.0)
        low = gram[rest] % (SYMBOLS * SYMBOLS)
        at, known = _find(self.pair, low)
        out[rest] = lost + np.where(known, self.pair_p[at], self.one_b[low // SYMBOLS] + self.one_p[low % SYMBOLS])
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts of the counts 0, 1, 2 and 3 or more, from the counts of counts."""
    return discounts(*(float((counts == i).sum()) for i in range(1, 5)))


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def _level(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of one order, given those of the order below, and the back-off weight of each context."""
    d = _discounts(counts)[np.minimum(counts, 3).astype(int)]
    total = counts.sum(-1, keepdims=True)
    safe = np.maximum(total, 1)
    gamma = np.where(total > 0, d.sum(-1, keepdims=True) / safe, 1.0)
    return (counts - d) / safe + gamma * lower, gamma[..., 0]


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> CharModel:
    three = np.zeros(GRAMS)
    three[gram] = n
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = (three > 0).sum(0).astype(float)
    one = (two > 0).sum(0).astype(float)
    p1, _ = _level(one, np.full(SYMBOLS, 1 / SYMBOLS))
    p2, b2 = _level(two, p1)
    p3, b3 = _level(three, p2)
    tri, pair, context = np.flatnonzero(three), np.flatnonzero(two), np.flatnonzero(three.sum(-1))
    return CharModel(tri, np.log10(p3.ravel()[tri]), pair, np.log10(p2.ravel()[pair]), context, np.log10(np.maximum(b3.ravel()[context], 1e-12)), np.log10(p1), np.log10(np.maximum(b2, 1e-12)))


def train(grams: DataFrame) -> dict[int, CharModel]:
    """One model per slot, from at most (MAX_LANGS + 1) * 64^3 rows."""
    rows = grams.toArrow()
    slot, gram, n = (rows.column(c).to_numpy() for c in ("slot", "gram", "n"))
    return {int(s): kneser_ney(gram[slot == s], n[slot == s]) for s in np.unique(slot)}
