"""Order-preserving packing of documents into token sequences.

Documents keep the order in which they are stored. Each task streams its own rows: there is
no shuffle, and what a task holds is one Arrow batch and one block of tokens. A block's window
cuts are chosen by dynamic programming over document ends, sentence ends and, in stretches
without either, regular positions. The cost of a window is its padding plus a penalty for the
kind of its last cut; the best earlier cut within reach is kept in a monotone queue, and
windows of exactly a power of two, which need no padding, are tried besides. The last window
of a block is not fixed but carried into the next one.

Text is tokenised word by word through a bounded cache. The tokenizer splits at white space and
joins no two words, so the ids are those of the whole text; a text that spells out a special
token is encoded whole.

Defined results: null text is empty and has only the end id; null and repeated keys are kept as
they are, row by row; other columns are dropped; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 4096
END_ID = 2
#: Tokens of one dynamic program.
BLOCK_TOKENS = 1 << 20
#: A stretch without a sentence end beyond this is given cuts every ``FORCED_STEP`` tokens.
LONG_STRETCH, FORCED_STEP = 256, 64
#: Penalties of a cut, in tokens of padding: at a sentence end, inside a sentence.
SENTENCE_CUT, FORCED_CUT = 4, 32
#: Words the tokenizer cache holds (about 170 bytes each); it starts anew beyond.
CACHE_WORDS = 1_200_000
CACHED_CHARS = 64


def _byte_letters() -> dict[int, str]:
    """The character byte-level BPE writes each byte as: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Words of Latin letters, digits and marks (no apostrophe, no odd white space, no superscript figure): the tokenizer
#: lower-cases them and splits them into runs of letters, single digits and runs of marks.
_PLAIN = re.compile(r"[!-&(-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u00ff]+")
_PARTS = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+")


class WordIds(dict):
    """Little-endian 32-bit ids of a word, as bytes; filled on demand."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.sentence_end = np.zeros(1 << 17, bool)
        for mark in ".!?":
            found = self.tokenizer.token_to_id(f"{mark}</w>")
            if found is not None:
                self.sentence_end[found] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_letters(self, word: str) -> bytes:
        """A word of lower-case Latin letters: the tokenizer neither changes nor splits it before its merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_CHARS:
            return self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if _PLAIN.fullmatch(word):
            if (lower := word.lower()) != word:
                found = self[lower]
            elif len(parts := _PARTS.findall(word)) > 1:
                found = b"".join(map(self.__getitem__, parts))
            else:
                found = self.encode_letters(word) if word.isalpha() else self.encode(word)
        else:
            found = self.encode(word)
        self[word] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if "<|" in text:
            return np.frombuffer(self.encode(text), "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), "<u4")


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer and its cache, once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


class Doc(NamedTuple):
    """A document, or the rest of one: ``ids`` begins at token ``start`` of ``total``."""

    key: object
    ids: np.ndarray
    start: int
    total: int


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions joined documents may be cut at, rising from 0, and their penalties; document ends are free."""
    inside = np.flatnonzero(sentence_end[ids]) + 1
    inside = inside[~np.isin(inside + 1, ends)]  # the end id alone is no sentence
    inside = inside[~np.isin(inside, ends)]
    marks = np.sort(np.concatenate([[0], inside, ends]))
    forced = [np.arange(marks[i] + FORCED_STEP, marks[i + 1], FORCED_STEP) for i in np.flatnonzero(np.diff(marks) > LONG_STRETCH)]
    points = np.concatenate([[0], ends, inside, *forced]).astype(np.int64)
    costs = np.concatenate([np.zeros(1 + len(ends)), np.full(len(inside), SENTENCE_CUT), *[np.full(len(f), FORCED_CUT) for f in forced]])
    order = np.argsort(points, kind="stable")
    return points[order], costs[order].astype(np.int64)


def choose_cuts(position: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indices into ``position`` (rising from 0, steps of at most ``length``) of the cheapest cuts."""
    exact: dict[int, list[int]] = {}
    size = 1
    place = np.full(int(position[-1]) + 1, -1, np.int32)
    place[position] = np.arange(len(position))
    while size < length:
        back_to = position - size
        at = np.where(back_to >= 0, place[np.maximum(back_to, 0)], -1)
        for j in np.flatnonzero(at >= 0).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    pos, pay = position.tolist(), cost.tolist()
    best, back = [0] * len(pos), [0] * len(pos)
    queue = deque([(0, 0, 0)])  # (cheapest cost plus position, position, index), rising in all
    for j in range(1, len(pos)):
        here = pos[j]
        while here - queue[0][1] > length:
            queue.popleft()
        low, _, i = queue[0]
        low += length - here
        if j in exact:
            for k in exact[j]:
                if best[k] < low:
                    low, i = best[k], k
        best[j], back[j] = low + pay[j], i
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _pieces(docs: list[Doc], cuts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, from, to, window, offset in the window) for cut positions over the joined documents."""
    window = at = begin = 0
    for d, doc in enumerate(docs):
        done = 0
        while done < len(doc.ids) and window < len(cuts):
            take = min(len(doc.ids) - done, cuts[window] - at)
            yield d, done, done + take, window, at - begin
            done += take
            at += take
            if at == cuts[window]:
                window, begin = window + 1, at


def _plan(docs: list[Doc], sentence_end: np.ndarray, length: int) -> list[int]:
    position, cost = cut_points(np.concatenate([d.ids for d in docs]), np.cumsum([len(d.ids) for d in docs]), sentence_end)
    return position[choose_cuts(position, cost, length)].tolist()


def _schema(key: T.StructField) -> T.StructType:
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    return T.StructType([key, *[T.StructField(n, T.LongType()) for n in names], T.StructField("ids", T.BinaryType())])


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32 bits).

    ``sequence_id`` is unique over the table: the task's number and a running number inside it.
    """
    schema = _schema(docs.schema[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[Doc] = []
        tokens, kind = 0, None

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, tokens, sequence
            cuts = _plan(waiting, words.sentence_end, length)
            if not last:
                cuts.pop()  # the open window goes on in the next block
            rows, done = [], [0] * len(waiting)
            for d, begin, end, window, offset in _pieces(waiting, cuts):
                doc = waiting[d]
                rows.append((doc.key, doc.start + begin, end - begin, doc.total, sequence + window, offset, doc.ids[begin:end].tobytes()))
                done[d] = end
            sequence += len(cuts)
            waiting = [Doc(x.key, x.ids[n:], x.start + n, x.total) for x, n in zip(waiting, done, strict=True) if n < len(x.ids)]
            tokens = sum(len(x.ids) for x in waiting)
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:6]], pa.array(columns[6], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(words.ids(value.as_py()), np.uint32(end_id)).astype("<u4")
                waiting.append(Doc(name.as_py(), ids, 0, len(ids)))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from emit(False)
        if waiting:
            yield from emit(True)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def report(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    pieces = pack(docs, tokenizer, key=key, text=text)
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
