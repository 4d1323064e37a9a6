"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items are normalised to words and entered into one automaton per bounded block of items.
Document words are streamed through it, tracking the length of the longest match that ends at
each word; a match of a whole window (13 words, or a shorter item's every word) marks the
words of the window. Two steps keep the stream short without changing its result: a match of
``m`` words needs ``m - 1`` neighbouring word pairs that occur in items, so only runs of such
pairs (found by hash, in numpy, over whole slices of documents) are walked, and the walk
compares the words themselves.

Documents are never shuffled; items are broadcast in blocks of at most ``BLOCK_CHARS``
characters, and a document meets one block after another.

Defined results: null or empty text has no words, no hits and is not contaminated; items
without words are ignored; an item with a null id marks words but is neither counted nor
listed; repeated items count once by id; repeated documents are judged row by row; an empty
benchmark hits nothing. Other columns are passed through, but the
struct of hits replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import ALNUM, Words, mix, slices, words_of
from nodeloom.llm.columns import Added

WINDOW = 13
#: Share of a document's words, as 1 / COVER, from which it counts as contaminated.
COVER = 20
#: Characters of item text in one broadcast block, hence the bound of one automaton.
BLOCK_CHARS = 1_000_000
#: Automata a task holds at once; further blocks build theirs again when they match.
LIVE_BLOCKS = 4
_BITS = 20

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("contaminated", T.BooleanType()),
])
HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.list_(pa.int64()))), ("contaminated", pa.bool_()),
])


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of every state of window length."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, int] = {}

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, parent: int, word: bytes) -> int:
        """The state of ``parent``'s longest string plus ``word``, split off a longer one if need be."""
        old = self.next[parent][word]
        if self.length[old] == self.length[parent] + 1:
            return old
        copy = self._state(self.length[parent] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def add(self, words: list[bytes]) -> int:
        """Enter an item; returns the state of the whole item."""
        last = 0
        for word in words:
            last = self._extend(last, word)
        return last

    def mark(self, words: list[bytes], item: int, window: int) -> None:
        """Note the item on the states of its windows (after all items have been entered)."""
        if len(words) < window:
            state = 0
            for word in words:
                state = self.next[state][word]
            self.whole[state] = len(words)
            self.items.setdefault(state, set()).add(item)
            return
        for state, length in self.walk(words, window):
            if length >= window:
                self.items.setdefault(state, set()).add(item)

    def walk(self, words: list[bytes], window: int) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word.

        A match longer than a window keeps its length, but the state is the one of its last
        ``window`` words, whose items share exactly that window.
        """
        nexts, links, lengths = self.next, self.link, self.length
        state = length = 0
        for word in words:
            while state and word not in nexts[state]:
                state = links[state]
                length = lengths[state]
            target = nexts[state].get(word)
            state, length = (0, 0) if target is None else (target, length + 1)
            cut = state
            if length > window:
                while lengths[links[cut]] >= window:
                    cut = links[cut]
            yield cut, length


@dataclass
class Block:
    """One block of items: the word pairs that can be part of a match, and the automaton once it is needed."""

    lists: list[list[bytes]]
    window: int
    need: int
    keys: np.ndarray
    bitmap: np.ndarray
    automaton: SuffixAutomaton | None = None
    shorts: list[int] | None = None

    def ready(self) -> None:
        """Build the automaton."""
        self.automaton = automaton = SuffixAutomaton()
        full = [i for i, words in enumerate(self.lists) if words]
        for i in full:
            automaton.add(self.lists[i])
        for i in full:
            automaton.mark(self.lists[i], i, self.window)
        self.shorts = [-1] * len(automaton.next)
        for state in sorted(range(1, len(self.shorts)), key=automaton.length.__getitem__):
            self.shorts[state] = state if state in automaton.whole else self.shorts[automaton.link[state]]

    def member(self, keys: np.ndarray) -> np.ndarray:
        out = self.bitmap[keys & np.uint64((1 << _BITS) - 1)]
        some = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        out[some] = self.keys[at] == keys[some]
        return out


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] + (hashes[1:] << np.uint64(1)))


def build_block(items: list[tuple[int | None, str]], window: int) -> Block | None:
    """The automaton of one block; items are numbered by position. None when no item has a word."""
    found = words_of(pa.array([text for _, text in items], pa.large_string()), ALNUM)
    hashes, lists = found.hashes(), []
    for i in range(len(items)):
        lists.append([found.word(k) for k in range(found.first[i], found.first[i + 1])])
    full = [i for i, words in enumerate(lists) if words]
    if not full:
        return None
    need = min(min(len(lists[i]), window) for i in full)
    if need == 1:
        keys = np.unique(hashes)
    else:
        text = found.text_of_word()
        keys = np.unique(_pairs(hashes)[text[1:] == text[:-1]])
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[keys & np.uint64((1 << _BITS) - 1)] = True
    return Block(lists, window, need, keys, bitmap)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def candidate_runs(words: Words, hashes: np.ndarray, block: Block) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end word) of the stretches that can hold a whole window."""
    if not len(words):
        return
    text = words.text_of_word()
    if block.need == 1:
        begin, end = _runs(block.member(hashes))
        cuts = words.first[1:-1]
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            edges = [b, *cuts[np.searchsorted(cuts, b, "right"):np.searchsorted(cuts, e, "left")].tolist(), e]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x < y:
                    yield int(text[x]), x, y
        return
    flags = block.member(_pairs(hashes)) & (text[1:] == text[:-1])
    begin, end = _runs(flags)
    keep = end - begin >= block.need - 1
    for b, e in zip(begin[keep].tolist(), end[keep].tolist(), strict=True):
        yield int(text[b]), b, e + 1


def match(words: Words, hashes: np.ndarray, block: Block, live: list[Block]) -> Iterator[tuple[int, int, int, int, set[int]]]:
    """(text, first word, end word, longest match, items) of every window found, word numbers in the slice.

    ``live`` lists the blocks that hold an automaton; the oldest gives its up beyond ``LIVE_BLOCKS``.
    """
    window = block.window
    for text, begin, end in candidate_runs(words, hashes, block):
        if block.automaton is None:
            block.ready()
            live.append(block)
            if len(live) > LIVE_BLOCKS:
                old = live.pop(0)
                old.automaton = old.shorts = None
        automaton, shorts = block.automaton, block.shorts
        run = [words.word(k) for k in range(begin, end)]
        for k, (state, length) in enumerate(automaton.walk(run, window)):
            stop = begin + k + 1
            if length >= window:
                yield text, stop - window, stop, length, automaton.items[state]
            short = shorts[state]
            while short > 0:
                size = automaton.whole[short]
                if size <= length:
                    yield text, stop - size, stop, length, automaton.items[short]
                short = shorts[automaton.link[short]]


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _matcher(handles: list, column: int, window: int, cover: int, finish: Callable) -> Callable:
    """The task: every block of items against every slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [build_block(handle.value, window) for handle in handles]
        live: list[Block] = []
        for batch in batches:
            for begin, end in slices(batch.column(column)):
                part = batch.slice(begin, end - begin)
                words = words_of(part.column(column), ALNUM)
                hashes = words.hashes()
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[int]] = {}
                longest: dict[int, int] = {}
                for block, handle in zip(blocks, handles, strict=True):
                    if block is None:
                        continue
                    for text, first, stop, best, found in match(words, hashes, block, live):
                        spans.setdefault(text, []).append((first, stop))
                        longest[text] = max(longest.get(text, 0), best)
                        items.setdefault(text, set()).update(handle.value[k][0] for k in found if handle.value[k][0] is not None)
                rows = []
                for text in range(part.num_rows):
                    base, size = int(words.first[text]), int(words.first[text + 1] - words.first[text])
                    merged = _merge(spans[text]) if text in spans else []
                    hit = sum(e - b for b, e in merged)
                    rows.append({
                        "n_words": size, "n_hit": hit, "longest": longest.get(text, 0), "items": sorted(items.get(text, ())),
                        "spans": [[b - base, e - base] for b, e in merged], "contaminated": hit > 0 and cover * hit >= size})
                yield finish(part, rows, words)

    return run


def _blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> list:
    """Broadcast handles of the items, each block at most ``block_chars`` characters or one item."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    handles, block, size = [], [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["t"]) > block_chars:
            handles.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((row["k"], row["t"]))
        size += len(row["t"])
    if block:
        handles.append(spark.sparkContext.broadcast(block))
    return handles


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "item_id", item_text: str = "text",
         window: int = WINDOW, cover: int = COVER, out: str = "hits", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a struct of word counts, matched items, matched word spans and the verdict, which replaces a column of that name."""
    added = Added(docs, [T.StructField(out, HITS)])

    def finish(part: pa.RecordBatch, rows: list[dict], words: Words) -> pa.RecordBatch:
        return added.batch(part, [pa.array(rows, HITS_ARROW)])

    handles = _blocks(benchmark, key, item_text, block_chars)
    return docs.mapInArrow(_matcher(handles, docs.columns.index(text), window, cover, finish), added.schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", cut_spans: bool = False, **options) -> DataFrame:
    """Documents that are not contaminated, columns unchanged.

    A document beyond the coverage limit goes. With ``cut_spans`` the matched spans of the
    others are cut out of their texts as well; otherwise a document below the limit stays as it is.
    """
    index = docs.columns.index(text)
    window, cover = options.get("window", WINDOW), options.get("cover", COVER)

    def finish(part: pa.RecordBatch, rows: list[dict], words: Words) -> pa.RecordBatch:
        if cut_spans:
            column = part.column(index).to_pylist()
            base = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in column])])
            for i, row in enumerate(rows):
                if row["spans"] and not row["contaminated"]:
                    raw, first = column[i].encode(), int(words.first[i])
                    for b, e in reversed(row["spans"]):
                        x, y = int(words.start[first + b] - base[i]), int(words.end[first + e - 1] - base[i])
                        raw = raw[:x] + raw[y:]
                    column[i] = raw.decode()
            part = part.set_column(index, part.schema.field(index), pa.array(column, part.schema.field(index).type))
        return part.filter(pa.array([not row["contaminated"] for row in rows], pa.bool_()))

    handles = _blocks(benchmark, options.get("key", "item_id"), options.get("item_text", "text"), options.get("block_chars", BLOCK_CHARS))
    return docs.mapInArrow(_matcher(handles, index, window, cover, finish), docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, hit words, matched items and the verdict."""
    found = find(docs.select(key, text), benchmark, text=text, out="hits")
    names = F.sort_array(F.transform("hits.items", lambda i: i.cast("string")))
    return found.select(
        key, F.col("hits.n_words").alias("n_words"), F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), F.col("hits.contaminated").alias("contaminated"))
