"""Words, lines and windows of a batch of texts as numpy arrays, read from Arrow's own buffers.

A text is its UTF-8 bytes; a word is a run of bytes other than space and U+0009 to U+000D. Hashes
are 64-bit: a polynomial over the bytes, taken from prefix sums, and a mixer on top.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
SMALL_CHUNK = 256 << 10  # for steps that keep many numbers a byte
_P = np.uint64(0x9E3779B97F4A7C55)
_Q = np.uint64(0xD6E8FEB86659FD93)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SMALL_CHUNK + 2), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1:  # those of one very long text are not kept in the worker
            _powers[name] = have
    return have[:n]


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


@dataclass
class Texts:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each row begins and ends in them."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        opens[self.bounds[:-1]] = True
        closes[self.bounds[1:]] = True
        return opens[:n], closes[1:]

    def spans(self, separator: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run, within a row, of bytes that are no separators; a new run begins
        where ``cut`` is true as well."""
        inside = ~separator
        opens, closes = self._edges()
        if cut is not None and len(cut):
            opens, closes = opens | cut, closes | np.concatenate((cut[1:], [False]))
        before = np.concatenate(([True], separator[:-1])) if len(inside) else separator
        after = np.concatenate((separator[1:], [True])) if len(inside) else separator
        return np.flatnonzero(inside & (before | opens)), np.flatnonzero(inside & (after | closes)) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each word, in order."""
        start, end = self.spans(_IS_SPACE[self.data])
        return start, end, self.row_of(start)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hash of each span of bytes."""
        data = _LOWER[self.data] if lower else self.data
        n = len(data)
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _P, n), out=upto[1:])
        return mix((upto[end] - upto[start]) * _power("down", _INVERSE, n + 1)[start] + (end - start).astype(np.uint64) * _Q)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each line, cut at line feeds; a row without bytes has one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        rows = np.concatenate((np.arange(self.rows), self.row_of(feeds)))
        start = np.concatenate((self.bounds[:-1], feeds + 1))
        end = np.concatenate((feeds, self.bounds[1:]))
        end_rows = np.concatenate((self.row_of(feeds), np.arange(self.rows)))
        by_start, by_end = np.lexsort((start, rows)), np.lexsort((end, end_rows))
        return start[by_start], end[by_end], rows[by_start]


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 10) -> np.ndarray:
    """The bytes of many spans one after the other, each followed by the byte ``gap``."""
    size = end - start + 1
    upto = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(upto[-1]) - np.repeat(upto[:-1] - start, size)
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    out[upto[1:] - 1] = gap
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """All rows in order, in chunks of whole rows; a chunk over ``limit`` bytes has one row."""
    data, offsets = buffers(texts)
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Texts(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items; the entry at i is right only if i and i + k - 1 share a row."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _Q + hashes[j : j + n]
    return mix(out)


def whole_windows(rows: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k consecutive items lie in one row."""
    n = max(0, len(rows) - k + 1)
    return rows[:n] == rows[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal hashes of the same row."""
    return mix(hashes + rows.astype(np.uint64) * _P)
