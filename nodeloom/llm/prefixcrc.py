"""CRC-32 of any run of words from the running CRCs of one scan.

A text's words, each after one space, are scanned once; the CRC after every word is kept. With A
the bytes before a run and B the run itself, ``crc(B) = crc(AB) ^ shift(crc(A), len(B))``: appending
zero bytes is a linear map over GF(2), so the part of A cancels and no byte is read twice. The shift
by up to 63 bytes is four table reads, a longer one goes on by powers of two.
"""

from __future__ import annotations

from itertools import accumulate
from re import compile as pattern
from zlib import crc32

import numpy as np

from nodeloom.llm.bytewords import Words

_NEAR = 64
_FAR_BITS = 32
_TOKEN = pattern(rb" [^ ]+")
#: Words scanned at a time.
SCAN_WORDS = 1 << 17


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> 1), value >> 1).astype(np.uint32)
    return value


_STEP = _byte_table()


def _after_zero(crc: np.ndarray) -> np.ndarray:
    return _STEP[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map given by the images of each byte in each of the four places."""
    out = tables[0][crc & np.uint32(255)]
    for place in (1, 2, 3):
        out = out ^ tables[place][(crc >> np.uint32(8 * place)) & np.uint32(255)]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    same = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = [same]
    for _ in range(_NEAR):
        near.append(_after_zero(near[-1]))
    far = [near.pop()]
    for _ in range(_FAR_BITS - 1):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


_NEAR_TABLES, _FAR_TABLES = _tables()
_NEAR_FLAT = _NEAR_TABLES.ravel()


def shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC moved on by so many zero bytes (without the final complement)."""
    base = (zeros % _NEAR).astype(np.int64) * 1024
    out = _NEAR_FLAT[base + (crc & np.uint32(255))]
    for place in (1, 2, 3):
        out ^= _NEAR_FLAT[base + 256 * place + ((crc >> np.uint32(8 * place)) & np.uint32(255))]
    blocks = zeros // _NEAR
    rows = np.flatnonzero(blocks)
    for bit in range(_FAR_BITS):
        if not len(rows):
            break
        some = rows[(blocks[rows] >> bit) & 1 == 1]
        out[some] = _apply(_FAR_TABLES[bit], out[some])
        rows = rows[blocks[rows] >> (bit + 1) > 0]
    return out


def _spaced(words: Words, low: int, high: int) -> bytes:
    """Words ``low`` to ``high``, each after one space."""
    begin, end = words.start[low], words.end[high - 1]
    size = words.end[low:high] - words.start[low:high]
    within = words.data[begin:end]
    out = np.full(int(size.sum()) + high - low, 0x20, np.uint8)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(1, high - low + 1), size)
    out[at] = within[within != 0]
    return out.tobytes()


class PrefixCrcs:
    """Running CRCs over the words of a slice of texts."""

    def __init__(self, words: Words):
        self.words = words
        n = len(words)
        self.after = np.zeros(n + 1, np.uint32)  # CRC after each word, a zero first
        crc = 0
        for low in range(0, n, SCAN_WORDS):
            high = min(low + SCAN_WORDS, n)
            tokens = _TOKEN.findall(_spaced(words, low, high))
            self.after[low + 1:high + 1] = np.fromiter(accumulate(tokens, lambda c, w: crc32(w, c), initial=crc), np.uint32, high - low + 1)[1:]
            crc = int(self.after[high])
        raw = ~self.after[:-1]  # CRC after the space before each word
        self.before = ~(_STEP[(raw ^ np.uint32(0x20)) & np.uint32(255)] ^ (raw >> np.uint32(8)))
        self.total = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])  # bytes up to each word's end

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, text) of every run of ``size`` words inside one text, in order."""
        text = self.words.text_of_word()
        last = np.arange(size - 1, len(text))
        first = last - (size - 1)
        inside = text[first] == text[last]
        first, last = first[inside], last[inside]
        length = self.total[last + 1] - self.total[first] - 1
        return self.after[last + 1] ^ shift(self.before[first], length), text[first]
