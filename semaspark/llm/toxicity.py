"""Toxicity of texts whose words may be disguised: a noisy channel is undone first, then the restored words are scored.

Restoring. A character model (charlm.py) is counted over all texts. A word of plain letters, none doubled, stands for itself.
Any other word, of any length, becomes a lattice: each run of a character may stand for itself, for letters that it looks like,
for fewer repetitions, for nothing, or for the end of a word; Viterbi search under the character model and fixed channel costs
picks the spelling; a word with doubled letters counts both ways. Signs that end a word count both as letters and as nothing. Neighbours are also read together where white
space may be noise: runs of three or more one-character words, and words that the character model finds ``10^JOIN`` times
likelier as one. Such a run of three or more goes through the lattice with an end of a word allowed at each white space; where these ends are in doubt, each place may begin a word.

Scoring. From at most ``SAMPLE`` labelled rows, outside the held-out ones, the ``FEATURES`` restored words and word beginnings that
tell the labels apart best (log-likelihood ratio) get weights by logistic regression. A text's score is the logistic
of the weights of its distinct features. Labels, language, source and id are no inputs.

Null texts are empty; empty texts get the score of the bias. Null labels don't count; with no label or one class only,
every score is the share of positive labels (0 if there are none). Repeated rows are scored row by row. Empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaspark.llm.charlm import GRAMS, SYMBOLS, count_grams, symbol_table, train
from semaspark.llm.frames import stage, table
from semaspark.llm.words import Texts, chunks, gather

SAMPLE = 20_000
FEATURES = 4096
LEAST_RATIO = 10.0
PREFIXES = (4, 5, 6)
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LOOK_COST, REPEAT_COST, TWICE_COST, DROP_COST, ODD_COST, BREAK_COST, SPLIT_COST = -0.6, -0.3, -3.0, -0.4, -0.6, -0.4, -1.2
SIGN_COSTS = (-1.0, -2.0, -0.5)  # of dropping one, two, or three and more equal look-alike signs at an end of a word
JOIN = 1.0
SEPARATORS = ".-_* '~"
SIGNS = "".join(c for c in LOOKS_LIKE if not c.isalnum())
EDGE = " \t.,;:?\"')[]{}<>#%&*=/\\-_~^`"
REMEMBERED = 256
WITHIN = max(PREFIXES) + 1
_RUNS = re.compile(r"(.)\1*", re.S)
_PIECES = re.compile(r"(?:([a-z])(?!\1))+|(.)\2*", re.S)  # a stretch of letters that stand for themselves, or a run
_PLAIN = re.compile("[a-z]+")
_DEALT = re.compile(rf"[^{re.escape(SEPARATORS)}](?:[{re.escape(SEPARATORS)}][^{re.escape(SEPARATORS)}])+")
_THRICE = re.compile(r"(.)\1\1", re.S)
_TWICE = re.compile(r"(.)\1", re.S)


@lru_cache(4096)
def _options(char: str, times: int, inner: bool, last: bool, split: bool, kept: bool) -> list[tuple[tuple[int, ...], str, float]]:
    """What a run of one character may stand for, as symbols and text, with the log10 cost of the channel; a space is the end of
    a word. ``split``: white space lies inside the run; ``kept``: signs at an end are letters."""
    out = []
    for letter, cost in [(char, 0.0 if char.isalnum() else ODD_COST), *((x, LOOK_COST) for x in LOOKS_LIKE.get(char, ""))][last and kept and char in SIGNS :]:
        if times == 1:
            out.append((letter, cost))
        elif times == 2:
            out += [(letter * 2, cost), (letter, cost + TWICE_COST)]
        else:
            out += [(letter, cost + REPEAT_COST), (letter * 2, cost + 2 * REPEAT_COST)]
        if split:
            out.append((f"{letter} {letter}", cost + BREAK_COST))
    if inner and char in SEPARATORS:
        out.append(("", DROP_COST))
    if inner and not char.isalnum():
        out.append((" ", SPLIT_COST if char in SEPARATORS else BREAK_COST))
    if not inner and not char.isalnum() and not kept:
        out.append(("", 0.0 if last and char == "!" or char not in LOOKS_LIKE else SIGN_COSTS[min(times, 3) - 1]))
    return [(_symbols(text), text, cost) for text, cost in out]


def _within(restored: str) -> set[str]:
    """What begins at each place of a phrase whose ends of words are in doubt, one letter longer than the longest beginning
    that is a feature."""
    text = restored.replace(" ", "")
    return {text[i : i + WITHIN] for i in range(len(text) - 2)}


_SEAM = [((), "", 0.0), ((0,), " ", BREAK_COST)]


def _symbols(text: str) -> tuple[int, ...]:
    table_ = symbol_table()
    return tuple(0 if c == " " else int(table_[min(ord(c), 65535)]) for c in text)


@dataclass
class Spellings:
    """Distinct words in lower case without the signs of EDGE, as code points. Those of ``letters`` have letters only, none three times
    in a row; ``plain`` ones have none twice in a row either."""

    texts: list[str]
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    plain: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Spellings:
        texts = [w.strip(EDGE) for w in "\n".join(words).lower().split("\n")] if words else []
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        end = np.flatnonzero(points == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        upto = np.concatenate(([0], np.cumsum(~_is_letter(points))))
        same = np.concatenate((points[1:] == points[:-1], [False]))[: len(points)]
        twice = np.concatenate(([0], np.cumsum(same)))
        thrice = np.concatenate(([0], np.cumsum(same & np.concatenate((same[1:], [False]))[: len(same)])))
        letters = (end > start) & (upto[end] == upto[start]) & (thrice[end] == thrice[start])
        return Spellings(texts, points, start, end, letters, letters & (twice[end] == twice[start]))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """What Restorer._ends gives for words of letters, not doubled at their first or last place, and which these are."""
        at, size = np.flatnonzero(self.letters), self.end - self.start
        first, last = self.start[at], self.end[at] - 1
        wide, one = size[at] > 1, np.minimum(1, size[at] - 1)
        four = self.points[np.stack([first, first + one, last - one, last], 1)]
        out, sure = np.zeros((len(size), 4), np.int64), np.zeros(len(size), bool)
        out[at] = symbol_table()[np.minimum(four, 65535)]
        out[at[~wide], 1:3] = 0
        sure[at] = ~wide | ((four[:, 0] != four[:, 1]) & (four[:, 2] != four[:, 3]))
        return out, sure


_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(65536)], bool))
    out = _letters[0][np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535).tolist():
        out[i] = chr(points[i]).isalpha()
    return out


class Restorer:
    def __init__(self, log_p: np.ndarray) -> None:
        self.table = log_p.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        self.log_p = log_p.tolist()  # of all trigrams
        self.symbol = symbol_table().tolist()
        self._remember = lru_cache(200_000)(self._restore)
        self._remember_features = lru_cache(200_000)(self._features)
        self._remember_run = lru_cache(50_000)(self._restore_run)

    def restore(self, word: str) -> str:
        """The likeliest spelling; several words are joined by spaces. Long words are decoded like others, but not remembered."""
        low = word.lower().strip(EDGE)
        return (self._remember if len(low) <= REMEMBERED else self._restore)(low)

    def _restore(self, low: str) -> str:
        if not low.isalpha():
            return self._decode(low, frozenset()) if low else low
        if not _TWICE.search(low):
            return low
        return self._decode(low, frozenset()) if _THRICE.search(low) else self._undouble(low)

    def _undouble(self, word: str) -> str:
        """What _decode gives for letters with doubled ones: trigrams make each choice depend on the letters next to it only."""
        symbol = self.symbol

        def single(m: re.Match) -> str:
            a, b = m.span()
            y = symbol[min(ord(word[a - 1]), 65535)] if a else 0
            c = symbol[min(ord(m[1]), 65535)]
            z = symbol[min(ord(word[b]), 65535)] if b < len(word) else 0
            two = (y * SYMBOLS + c) * SYMBOLS
            gain = self.log_p[two + z] - self.log_p[two + c] - self.log_p[(c * SYMBOLS + c) * SYMBOLS + z]
            return m[1] if gain + TWICE_COST > 0 else m[0]

        return _TWICE.sub(single, word)

    def undoubled(self, spelled: Spellings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points, starts and ends of all words, those of letters as _undouble gives them."""
        points = spelled.points
        inside = np.repeat(spelled.letters & ~spelled.plain, spelled.end - spelled.start + 1)
        at = np.flatnonzero(inside[:-1] & (points[1:] == points[:-1]))
        symbol = np.where(points == 10, 0, symbol_table()[np.minimum(points, 65535)]).astype(np.int64)
        y, c, z = np.where(at > 0, symbol[at - 1], 0), symbol[at], symbol[at + 2]
        p = self.table
        gain = p[y, c, z] - p[y, c, c] - p[c, c, z]
        kept = np.ones(len(points), bool)
        kept[at[gain + TWICE_COST > 0] + 1] = False
        upto = np.concatenate(([0], np.cumsum(kept)))
        return points[kept], upto[spelled.start], upto[spelled.end]

    def _restore_run(self, words: tuple[str, ...]) -> str:
        """The likeliest words of a run whose white space may stand inside of words."""
        low = [x for x in (w.lower().strip(EDGE) for w in words) if x]
        seams, at = set(), 0
        for w in low:
            at += len(w)
            seams.add(at)
        return self._decode("".join(low), seams) if low else ""

    def _decode(self, word: str, seams: set[int] | frozenset[int], kept: bool = False) -> str:
        """Viterbi search over the states of the character model: linear in the word's length. At ``seams`` a word may end."""
        pieces: list[str | list] = []
        for m in (_RUNS if seams else _PIECES).finditer(word):
            a, b = m.span()
            if m.lastindex == 1 and not seams:
                pieces.append(m[0])
                continue
            last = b == len(word)
            pieces.append(_options(word[a], b - a, 0 < a and not last, last, b - a > 1 and any(x in seams for x in range(a + 1, b)), kept))
            if b in seams and not last:
                pieces.append(_SEAM)
        log_p, symbol = self.log_p, self.symbol
        paths: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # by 64 times the symbol before the last and the last one
        for options in pieces:
            if isinstance(options, str):  # nothing to choose; states meet after two letters
                at = 0
                while len(paths) > 1 and at < len(options):
                    char, met = options[at], {}
                    s = symbol[ord(char)]
                    for state, (score, before) in paths.items():
                        score += log_p[state * SYMBOLS + s]
                        state = state % SYMBOLS * SYMBOLS + s
                        has = met.get(state)
                        if has is None or has[0] < score:
                            met[state] = (score, (before, char))
                    paths, at = met, at + 1
                if at < len(options):
                    ((state, (score, before)),) = paths.items()
                    rest = options[at:]
                    for char in rest:
                        s = symbol[ord(char)]
                        score += log_p[state * SYMBOLS + s]
                        state = state % SYMBOLS * SYMBOLS + s
                    paths = {state: (score, (before, rest))}
                continue
            if len(options) == 1 and len(paths) == 1 and len(options[0][0]) == 1:  # one letter after one state: nothing to choose
                (((s,), out, cost),), ((state, (score, before)),) = options, paths.items()
                paths = {state % SYMBOLS * SYMBOLS + s if s else 0: (score + cost + log_p[state * SYMBOLS + s], (before, out) if out else before)}
                continue
            after: dict[int, tuple[float, tuple]] = {}
            for symbols, out, cost in options:
                for state, (score, before) in paths.items():
                    score += cost
                    for s in symbols:
                        score += log_p[state * SYMBOLS + s]
                        state = state % SYMBOLS * SYMBOLS + s if s else 0
                    has = after.get(state)
                    if has is None or has[0] < score:
                        after[state] = (score, (before, out) if out else before)
            paths = after
        best = max(((score + log_p[state * SYMBOLS], back) for state, (score, back) in paths.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, text = best
            out.append(text)
        return " ".join(x for x in (w.strip(EDGE) for w in "".join(reversed(out)).split(" ")) if x)

    def readings(self, word: str) -> set[str]:
        """The words that a word stands for: as restored, as it is if it has letters only, and, where look-alike signs end it,
        with these as letters and as nothing."""
        low = word.lower().strip(EDGE)
        found = {self.restore(low)}
        if low.isalpha():
            found.add(low)
        elif low:
            if low[-1] in SIGNS:
                found.add(self._decode(low, frozenset(), kept=True))
                found.add(self.restore(low.rstrip(SIGNS + EDGE)))
            if len(low) > 2 * WITHIN and _DEALT.fullmatch(low):
                found.update(_within(self.restore(low)))
        return {x for w in found for x in w.split(" ")}

    def features(self, word: str) -> tuple[str, ...]:
        low = word.lower().strip(EDGE)
        return (self._remember_features if len(low) <= REMEMBERED else self._features)(low)

    def _features(self, word: str) -> tuple[str, ...]:
        if _PLAIN.fullmatch(word) and not _TWICE.search(word):
            return (word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)) if len(word) > 2 else ()
        return tuple({f for w in self.readings(word) if len(w) > 2 for f in (w, *(f"{w[:k]}~" for k in PREFIXES if len(w) > k))})

    def _ends(self, word: str) -> tuple[int, int, int, int]:
        """Symbols of the first two and the last two characters as restored; 0 is none. Digits and signs give none."""
        text = self.restore(word)
        if not text or not (text[0].isalpha() and text[-1].isalpha()):
            return 0, 0, 0, 0
        s = [self.symbol[min(ord(c), 65535)] for c in text[:2] + text[-2:]]
        return (s[0], s[1], s[-2], s[-1]) if len(text) > 1 else (s[0], 0, 0, s[0])

    def _all_ends(self, spelled: Spellings, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """_ends of all words: of four ASCII letters as they are written, of other words of letters as they are spelled."""
        wide = end - start > 1
        four = np.stack([data[start], data[np.where(wide, start + 1, start)], data[np.where(wide, end - 2, start)], data[end - 1]], 1)
        low = four | 32
        written = wide & ((low >= 97) & (low <= 122) & (four < 128)).all(1)
        out, sure = spelled.ends()
        out[written] = low[written].astype(np.int64) - 96
        for i in np.flatnonzero(~(written | sure)).tolist():
            out[i] = self._ends(spelled.texts[i])
        return out

    def _seams(self, ends: np.ndarray, row: np.ndarray, single: np.ndarray) -> np.ndarray:
        """After which words the white space may be noise: between two characters, and where the character model gives the
        words as one at least 10^JOIN times the probability that it gives them apart."""
        (two, one), (a, b) = ends[:-1, 2:].T, ends[1:, :2].T
        p = self.table
        gain = p[two, one, a] + p[one, a, b] - p[two, one, 0] - p[0, 0, a] - p[0, a, b]
        return (row[1:] == row[:-1]) & ((single[1:] & single[:-1]) | ((one > 0) & (a > 0) & (gain > JOIN)))

    def words(self, part: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of a chunk, which of them stand in the text, and their rows; what spaced words and parts of words
        may be together is added to both."""
        return self._words(part)[:3]

    def _words(self, part: Texts) -> tuple[list[str], np.ndarray, np.ndarray, Spellings]:
        """``words``, and how those are spelled that stand in the text: they come first."""
        start, end, row = part.words()
        _, first, which = np.unique(part.hashes(start, end), return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        words = gather(part.data, start, end).tobytes().decode("utf-8", "replace").split("\n")[:-1]
        spelled = Spellings.of(words)
        if len(which) < 2:
            return words, which, row, spelled
        single = np.array([len(w) == 1 or len(w.strip(EDGE)) == 1 for w in words], bool)[which]
        joins = self._seams(self._all_ends(spelled, part.data, start, end)[which], row, single)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], joins, [False])).astype(np.int8)))
        first, last = edges[::2], edges[1::2] + 1
        upto, word_at = np.concatenate(([0], np.cumsum(single))), which.tolist()
        extra, rows = [], []
        for a, b, alone, of in zip(first.tolist(), last.tolist(), (upto[last] - upto[first]).tolist(), row[first].tolist()):
            if b - a == 2:
                if alone < 2:
                    extra.append(words[word_at[a]] + words[word_at[a + 1]])
                    rows.append(of)
                continue
            run = tuple(words[i] for i in word_at[a:b])
            restored = (self._remember_run if sum(map(len, run)) <= REMEMBERED else self._restore_run)(run)
            found = set(restored.split(" "))
            if alone > WITHIN:
                found.update(_within(restored))
            if alone == len(run):
                found.add("".join(run))
            elif alone > 2:
                at = np.flatnonzero(np.diff(np.concatenate(([False], single[a:b], [False])).astype(np.int8)))
                found.update("".join(run[x:y]) for x, y in zip(at[::2], at[1::2]) if y - x > 2)
            found.discard("")
            extra += found
            rows += [of] * len(found)
        return words + extra, np.concatenate((which, np.arange(len(words), len(words) + len(extra)))), np.concatenate((row, np.array(rows, row.dtype))), spelled


_restorers: dict[bytes, Restorer] = {}


def _restorer(sent) -> Restorer:
    """One restorer per model and worker, so that what it has decoded is remembered between tasks."""
    key = md5(sent.value.tobytes()).digest()
    if key not in _restorers:
        _restorers.clear()
        _restorers[key] = Restorer(sent.value)
    return _restorers[key]


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log10 probability of every trigram of symbols, over all texts together."""
    models = train(count_grams(docs.select(F.col(text).alias("text"), F.lit(None).cast("string").alias("lang")), "text", "lang", {}))
    return models[0].score(np.arange(GRAMS)) if models else np.full(GRAMS, -np.log10(SYMBOLS))


@dataclass
class Wanted:
    """Features by number, and sorted hashes of their letters: of whole words (0), and of beginnings by their length."""

    names: dict[str, int]
    hashed: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(names: dict[str, int]) -> Wanted:
        hashed = {}
        for k in (0, *PREFIXES):
            texts = [f for f in names if (len(f) == k + 1 and f.endswith("~") if k else not f.endswith("~"))]
            spelled = [f[:-1] if k else f for f in texts]
            points = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
            bounds = np.cumsum([0, *map(len, spelled)])
            key = Texts(0, len(texts), points, bounds).hashes(bounds[:-1], bounds[1:])
            order = np.argsort(key)
            hashed[k] = key[order], np.array([names[f] for f in texts], np.int64)[order]
        return Wanted(names, hashed)

    def found(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one of ``some`` words and a feature of it as it is spelled, found by hashes."""
        words, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        all_points = Texts(0, 1, points, np.array([0, len(points)]))
        for k, (keys, numbers) in self.hashed.items():
            at = np.flatnonzero(some & (end - start > max(k, 2)))
            if not len(keys) or not len(at):
                continue
            key = all_points.hashes(start[at], start[at] + k if k else end[at])
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[where] == key
            words.append(at[hit])
            found.append(numbers[where[hit]])
        return np.concatenate(words), np.concatenate(found)


def _row_features(restorer: Restorer, part: Texts, wanted: Wanted | None) -> tuple[np.ndarray, list | np.ndarray]:
    """Distinct (row, feature) pairs; with ``wanted`` features are its numbers, else texts."""
    words, which, row, spelled = restorer._words(part)
    if wanted is None:
        numbers: dict[str, int] = {}
        each = [[numbers.setdefault(f, len(numbers)) for f in restorer.features(w)] for w in words]
        word, feature = np.repeat(np.arange(len(each)), [len(f) for f in each]), np.array([f for fs in each for f in fs], np.int64)
    else:
        numbers = wanted.names
        stand, pairs = len(spelled.texts), []
        for first, s in ((0, spelled), (stand, Spellings.of(words[stand:]))):
            # Words of letters stand for what is written and, if some are doubled, for that without the doubled ones; no spelling has
            # more characters than its word, so others of under three have no feature.
            for at, number in (wanted.found(s.points, s.start, s.end, s.letters), wanted.found(*restorer.undoubled(s), s.letters & ~s.plain)):
                pairs.append((at + first, number))
            rest = np.flatnonzero(~s.letters & (s.end - s.start > 2))
            more = [(i + first, numbers[f]) for i in rest.tolist() for f in restorer.features(s.texts[i]) if f in numbers]
            pairs.append(np.array(more, np.int64).reshape(-1, 2).T)
        word, feature = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(word, kind="stable")
        word, feature = word[order], feature[order]
    count = np.bincount(word, minlength=len(words))
    mine = count[which] > 0 if len(which) else np.zeros(0, bool)
    places = np.unique(row[mine].astype(np.int64) * len(words) + which[mine])
    rows, at = places // max(len(words), 1), places % max(len(words), 1)
    begin, many = (np.cumsum(count) - count)[at], count[at]
    got = feature[np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
    pairs = np.unique(np.repeat(rows, many) * max(len(numbers), 1) + got)
    rows, got = pairs // max(len(numbers), 1), pairs % max(len(numbers), 1)
    if wanted is not None:
        return rows, got
    names = list(numbers)
    return rows, [names[f] for f in got.tolist()]


def _count_features(sample: DataFrame, sent) -> DataFrame:
    """feature, label, n: how many rows of the sample have a feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = _restorer(sent), Counter()
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for part in chunks(batch.column(0)):
                row, features = _row_features(restorer, part, None)
                seen.update(zip(features, labels[row + part.first].tolist()))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["feature", "label", "n"])

    return sample.select("text", "label").mapInArrow(count, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n"))


def _best_features(counts: DataFrame, n_pos: int, n_neg: int, most: int) -> list[str]:
    """The features whose rows differ most between the labels, by log-likelihood ratio."""
    wide = counts.groupBy("feature").agg(*(F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "p"), (0, "q"))))
    both = F.col("p") + F.col("q")

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (both * share))).otherwise(0.0)

    ratio = part(F.col("p"), n_pos / (n_pos + n_neg)) + part(F.col("q"), n_neg / (n_pos + n_neg))
    return [r[0] for r in wide.where(ratio >= LEAST_RATIO).orderBy(F.desc(ratio), "feature").limit(most).select("feature").collect()]


def _logistic(row: np.ndarray, feature: np.ndarray, label: np.ndarray, n: int, decay: float = 0.02, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias, by gradient steps with a scale per weight."""
    w, moment, square = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(label.mean() / (1 - label.mean()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(w[n] + np.bincount(row, w[feature], len(label)))))
        wrong = p - label
        grad = np.append(np.bincount(feature, wrong[row], n) + decay * w[:n], wrong.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w -= 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def remainder(doc_id: str, divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def fit(docs: DataFrame, labels: DataFrame, log_p: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[str, int], np.ndarray]:
    """Features and weights, from the ``sample`` labelled rows with the least hashed ids."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # that many rows at most go to the tasks
    rows = stage(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id").select("text", "label"), "labelled")
    seen = dict(rows.groupBy("label").count().collect())
    n_pos, n_neg = seen.get(1, 0), seen.get(0, 0)
    if not (n_pos and n_neg):
        return {}, np.array([50.0 if n_pos else -50.0])
    sent = spark.sparkContext.broadcast(log_p)
    wanted = {f: i for i, f in enumerate(_best_features(_count_features(rows, sent), n_pos, n_neg, FEATURES))}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, names = _restorer(sent), Wanted.of(wanted)
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for part in chunks(batch.column(0)):
                for r, f in zip(*(x.tolist() for x in _row_features(restorer, part, names))):
                    found[r + part.first].append(f)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["label", "features"])

    got = rows.mapInArrow(pick, "label int, features array<int>").toArrow()
    lists = got.column("features").to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.array([f for x in lists for f in x], np.int64)
    return wanted, _logistic(row, feature, got.column("label").to_numpy().astype(float), len(wanted))


def score(docs: DataFrame, log_p: np.ndarray, wanted: dict[str, int], weights: np.ndarray, text: str = "text") -> Column:
    """The probability that a text is toxic."""
    sent, model = (docs.sparkSession.sparkContext.broadcast(x) for x in (log_p, (wanted, weights)))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        restorer, (names, w) = _restorer(sent), model.value
        names = Wanted.of(names)
        out = np.full(len(texts), w[-1])
        for part in chunks(texts):
            row, feature = _row_features(restorer, part, names)
            np.add.at(out, row + part.first, w[feature])
        return pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return scored(F.col(text))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    log_p = character_model(docs)
    wanted, weights = fit(docs, labels.where(remainder("doc_id", 5) != 0), log_p)
    out = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score(docs, log_p, wanted, weights).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
