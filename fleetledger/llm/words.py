"""Words and word shingles of a whole batch of texts at once, on the bytes of the batch.

A word is a run of bytes other than space and 0x09-0x0D. Those bytes never occur inside a character of UTF-8, so the
words equal those of the pattern [^\\x20\\x09-\\x0D]+ over characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Tables for the usual slice of a batch are kept; a longer text has its own.
_LEAST_BITS = 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the size is rounded up so that few tables are made."""
    size = 1 << max(_LEAST_BITS, (n - 1).bit_length())
    if size not in _powers:
        if size > 1 << _LEAST_BITS:
            _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


@dataclass
class Words:
    """data: the bytes of all texts; bounds: n + 1 offsets of texts; start, end, doc: one entry per word."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """n + 1 positions of each text's first word among all words."""
        return np.searchsorted(self.doc, np.arange(len(self.bounds)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from a polynomial over its bytes and its length."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(56)))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


#: Bytes between words: space and 0x09-0x0D.
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes between terms: all of ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words_of(column: pa.Array, lower: bool = False, between: np.ndarray = BLANKS) -> Words:
    """The words of a string array: runs of bytes that are not between words. A null is an empty text. lower: A-Z count
    as a-z."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~between[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    opens[cuts] = inside[cuts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(opens)
    return Words(data, bounds, start, np.flatnonzero(closes) + 1, np.searchsorted(bounds, start, "right") - 1)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of `size` words; fewer words are one run; no word, no run."""
    h, first = words.hashes(), words.first
    n = len(h) - size + 1
    runs = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            runs = runs * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
        runs = mix(runs)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + x
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
