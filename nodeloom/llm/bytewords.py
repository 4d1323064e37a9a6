"""Words of Arrow text columns as numpy arrays, a whole slice of documents at a time.

A slice is the UTF-8 buffer of several texts. Bytes are mapped through a table that
lower-cases A-Z and turns separators into 0; a word is a maximal run of other bytes inside
one text. Everything outside ASCII is part of a word in both tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_BYTES >= 0x80)
_IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))

#: Lower-cased letters, digits and everything outside ASCII.
ALNUM = np.where(_IS_ALNUM, _LOWER, 0).astype(np.uint8)
#: Lower-cased, separated by white space (a NUL byte separates too).
SPACED = np.where(_IS_SPACE, 0, _LOWER).astype(np.uint8)

SLICE_BYTES = 4 << 20


@dataclass
class Words:
    """Words of consecutive texts: ``data[start[i]:end[i]]``.

    Text ``t`` has words ``first[t]..first[t+1]`` and bytes ``bounds[t]..bounds[t+1]``;
    ``raw`` holds the bytes as they were.
    """

    raw: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, eight bytes a step; only words that are longer go on."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        length = self.end - self.start
        out = mix(length.astype(np.uint64))
        left, pos, rows = length.copy(), self.start.copy(), np.arange(len(length))
        while len(rows):
            take = np.minimum(left, 8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - take).astype(np.uint64) * np.uint64(8))
            out[rows] = mix(out[rows] ^ (at[pos] & mask))
            more = left > 8
            rows, pos, left = rows[more], pos[more] + 8, left[more] - 8
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column whose bytes stay near ``limit``; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        base = total[begin] - sizes[begin]
        stop = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
        yield begin, stop
        begin = stop


def words_of(column: pa.Array, table: np.ndarray) -> Words:
    """Words of every text in ``column``; null has none."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    source = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    data = table[source]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    begins[cuts] |= inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = bounds[1:][bounds[1:] > 0] - 1
    ends[cuts] |= inside[cuts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(source, data, bounds, start, end, np.searchsorted(start, bounds))
