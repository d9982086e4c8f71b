"""Words and rolling hashes of many texts at once, in numpy over Arrow buffers.

A slice is a run of rows of an Arrow string column, some megabytes long, or one row that is longer.
Hashes are 64 bits wide: a polynomial over a byte table, made position-free by the inverse power,
then mixed with the length. Two different words, or windows of words, of one text agree by chance
with probability 2^-64 each, so counts that compare hashes within a text are exact in practice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 22
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > BLOCK:
        return powers(BASE, n), powers(INVERSE, n)
    if not _POWERS:
        _POWERS.append((powers(BASE, BLOCK + 1), powers(INVERSE, BLOCK + 1)))
    return _POWERS[0]


@dataclass
class Texts:
    """Rows first..last of a batch: bytes, row borders within them, word borders, first word of each row."""

    first: int
    last: int
    data: np.ndarray
    borders: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def counts(self) -> np.ndarray:
        return np.diff(self.words)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def text(self, row: int) -> bytes:
        return self.data[self.borders[row]:self.borders[row + 1]].tobytes()


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into slices; a missing text is empty."""
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, n)
        yield _texts(first, last, everything[at[first]:at[last]], at[first:last + 1] - at[first])
        first = last


def _texts(first: int, last: int, data: np.ndarray, borders: np.ndarray) -> Texts:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Texts(first, last, data, borders, none, none, np.zeros(last - first + 1, np.int64))
    word = ~SPACE[data]
    opens = np.ones(len(data), dtype=bool)
    opens[1:] = ~word[:-1]
    opens[borders[:-1][borders[:-1] < len(data)]] = True
    closes = np.ones(len(data), dtype=bool)
    closes[:-1] = ~word[1:]
    closes[borders[1:][borders[1:] > 0] - 1] = True
    starts = np.flatnonzero(word & opens)
    ends = np.flatnonzero(word & closes) + 1
    return Texts(first, last, data, borders, starts, ends, np.searchsorted(starts, borders))


def word_hashes(texts: Texts, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; with `lower`, A-Z count as a-z."""
    out = np.zeros(len(texts.starts), np.uint64)
    table = LETTERS[LOWER] if lower else LETTERS
    at = 0
    while at < len(out):
        low = texts.starts[at]
        to = max(at + 1, int(np.searchsorted(texts.ends, low + BLOCK, "right")))
        block = texts.data[low:texts.ends[to - 1]]
        up, down = _powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * up[:len(block)], out=sums[1:])
        s, e = texts.starts[at:to] - low, texts.ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 places are left out."""
    size = max(0, len(hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += hashes[k:k + size] * np.uint64(pow(BASE, k + 1, 1 << 64))
    return mix(total)


def whole_windows(texts: Texts, n: int) -> np.ndarray:
    """Which windows of n words lie within one row."""
    size = max(0, len(texts.starts) - n + 1)
    row = texts.row_of_word()
    return row[:size] == row[n - 1:n - 1 + size]


def characters(texts: Texts) -> np.ndarray:
    """Code points of each word."""
    seen = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=seen[1:])
    return seen[texts.ends] - seen[texts.starts]


def per_row(texts: Texts, values: np.ndarray) -> np.ndarray:
    """Sum of a value per word over the words of each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[texts.words[1:]] - sums[texts.words[:-1]]
