"""Words of Arrow text batches as flat numpy arrays.

A batch is cut into slices of whole texts with a bounded number of bytes, so the arrays of a task
stay small whatever the texts' sizes.  A single text longer than the bound is its own slice.
Word hashes are 64-bit polynomials over bytes, taken from prefix sums; window hashes are
polynomials over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLOCK = 1 << 17

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of words: everything but white space; and ASCII letters, digits and all non-ASCII bytes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[list(SPACES)] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_random = np.random.RandomState(20240229)
_LETTER = _random.randint(0, 1 << 62, 1 << 8).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WINDOW = (np.uint64(0xD1342543DE82EF97), np.uint64(0xAF251AF3B0F025B7))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of a base modulo 2**64, as many as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            size = max(BLOCK + 1, 1 << (int(n) - 1).bit_length())
            row = np.full(size, self.base, np.uint64)
            row[0] = 1
            self.known = np.multiply.accumulate(row)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray,
                table: np.ndarray | None = _LETTER) -> np.ndarray:
    """64-bit hashes of ``values[start:end]`` for ascending spans that do not overlap.

    ``table`` maps each value to its random 64-bit number; without one, values are mixed.
    """
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        low = start[first]
        last = max(first + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
        high = end[last - 1]
        part = values[low:high]
        part = table[part] if table is not None else mix(part.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(part * _UP.upto(high - low), out=sums[1:])
        s, e = start[first:last] - low, end[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * _DOWN.upto(high - low + 1)[s]
        first = last
    return mix(out + (end - start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the row offsets; a null text is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if offsets is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of a slice: their row, byte span and hash, in text order."""

    def __init__(self, column: pa.Array, kind: np.ndarray = NON_SPACE, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        self.rows = len(self.offsets) - 1
        if lower:
            self.data = LOWER[self.data]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = kind[self.data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = np.unique(self.offsets[1:-1])
        cut = cut[(cut > 0) & (cut < len(self.data))]
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
        self.start, self.end = start, end
        #: Index of each row's first word, and one past the last word.
        self.first = np.searchsorted(start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def windows(self, size: int) -> np.ndarray:
        """Indexes of the words where a window of ``size`` words of one text starts."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[:n] == self.row[size - 1:])


def window_hashes(word: np.ndarray, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of the ``size`` values from each index ``at``; ``which``: independent kinds."""
    base, h = _WINDOW[which], np.zeros(len(at), np.uint64)
    salted = word if which == 0 else mix(word + np.uint64(which))
    for k in range(size):
        h = h * base + salted[at + k]
    return mix(h)
