"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  UTF-8 never uses those
bytes inside a character, so words of bytes are words of characters.  Hashes are 64-bit and depend
only on the bytes of the word, never on its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
#: Texts are taken in slices of about so many bytes, which bounds the temporary arrays.
SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is neither letter nor digit, for words without punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_tables: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        steps[0] = 1
        have = _tables[base] = np.multiply.accumulate(steps)
        if len(have) > 1 << 22:  # an unusually long text: do not keep its table
            del _tables[base]
    return have[:n]


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair, from one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    inverse = _powers(pow(base, -1, 2**64), n + 1)
    return mix((total[ends] - total[starts]) * inverse[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes between every start and end."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    return _range_hash(_BYTE_VALUE[data], starts, ends, BYTE_BASE)


@dataclass
class Words:
    """Words of the texts ``first .. first + n - 1`` of a batch."""

    data: np.ndarray  #: bytes of the slice
    first: int
    n: int
    start: np.ndarray  #: word -> first byte
    end: np.ndarray
    bounds: np.ndarray  #: text -> its first word; n + 1 entries
    text_bounds: np.ndarray  #: text -> its first byte in ``data``

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def lines(self, which: np.ndarray) -> bytes:
        """Some words, one per line, without a line feed at the end."""
        size = self.end[which] - self.start[which] + 1
        out = np.full(int(size.sum()), 0x0A, dtype=np.uint8)
        to = np.cumsum(size) - size
        out[ranges(to, size - 1)] = self.data[ranges(self.start[which], size - 1)]
        return out[:-1].tobytes()

    def of(self) -> np.ndarray:
        """Text number of every word, from 0."""
        return np.repeat(np.arange(self.n), np.diff(self.bounds))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def words_of(data: np.ndarray, at: np.ndarray, first: int = 0, gaps: np.ndarray = _SPACE) -> Words:
    """Words of adjacent texts in one byte array; ``at`` has their bounds."""
    at = at - at[0]
    n = len(at) - 1
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = gaps[data]
    # Boundaries between texts also end words; each empty gap in between is handled by sorting.
    change = blank[1:] != blank[:-1]
    inner = np.unique(at[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[~blank[1:-1][inner] & ~blank[1:-1][inner - 1]]
    edges = np.flatnonzero(change)
    if len(cut):
        edges = np.sort(np.concatenate([edges, cut, cut]), kind="stable")
    start, end = edges[0::2], edges[1::2]
    return Words(data, first, n, start, end, np.searchsorted(start, at), at)


def slices(column: pa.Array, size: int = SLICE_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Words]:
    """Whole texts in slices of about ``size`` bytes; a longer text is a slice of its own."""
    if not len(column):
        return
    at, data = string_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1))
        yield words_of(data[at[i] : at[j]], at[i : j + 1], i, gaps)
        i = j


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` adjacent words (n - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return _range_hash(hashes, at, at + k, WORD_BASE)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
