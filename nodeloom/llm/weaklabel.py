"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Votes are counted
per vote pattern over the whole table (at most 3 ** labellers patterns), and expectation-
maximisation on these counts estimates the class share and each labeller's vote rates in either
class. The posterior of a document's pattern is its weak label. A linear scorer on hashed
features is fitted to the posteriors of a bounded sample and scores every document.

Defined results: null or empty text has no words, so the length labeller alone votes; repeated
rows get equal scores; other columns are dropped by the report; an empty table gives no rows,
and a table on which all votes agree keeps the starting rates of the labellers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import SPACED, Words, mix, slices, words_of
from nodeloom.llm.columns import Added
from nodeloom.llm.samples import even, spread

LABELLERS = ("length", "symbols", "repeats", "variety", "sentences", "lines", "short_words", "bars")
#: Sampled documents the linear scorer is fitted on.
FIT_DOCS = 4_000
BITS = 12
WINDOW = 5
KEEP = 0.5
#: First rates of a labeller's votes (bad, abstain, good) in the bad and in the good class.
START = np.array([[0.30, 0.40, 0.30], [0.01, 0.39, 0.60]])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return flags


def _dup_lines(words: Words, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them equal to an earlier one, per text."""
    n = len(words.first) - 1
    if not len(words):
        return np.zeros(n, int), np.zeros(n, int)
    line = np.concatenate([[0], np.cumsum(words.raw == 10)])[words.start]
    begins = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
    place = np.arange(len(words)) - np.repeat(begins, np.diff(np.append(begins, len(words))))
    key = np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begins)
    owner = text[begins]
    _, first = np.unique(mix(key ^ mix(owner.astype(np.uint64))), return_index=True)
    earlier = np.ones(len(begins), bool)
    earlier[first] = False
    return np.bincount(owner, minlength=n), np.bincount(owner[earlier], minlength=n)


def votes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Votes per text and labeller: 1 good, -1 bad, 0 abstain."""
    n = np.diff(words.first)
    text = words.text_of_word()
    many, some = np.maximum(n, 1), n >= 20
    symbols = _sums(_SYMBOL[words.raw], words.bounds) / many
    bars = _sums(words.raw == 0x7C, words.bounds) / many
    own = mix(hashes ^ mix(text.astype(np.uint64)))
    _, first = np.unique(own, return_index=True)
    distinct = np.bincount(text[first], minlength=len(n)) / many
    hit = np.zeros(len(words) + 1, int)
    if len(words) >= WINDOW:
        key = own[:len(own) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = mix(key) + own[k:len(own) - WINDOW + 1 + k]
        at = np.flatnonzero(_repeated(key) & (text[WINDOW - 1:] == text[:len(text) - WINDOW + 1]))
        np.add.at(hit, at, 1)
        np.add.at(hit, at + WINDOW, -1)
    repeats = _sums(np.cumsum(hit)[:-1] > 0, words.first) / many
    last = words.data[words.end - 1] if len(words) else np.zeros(0, np.uint8)
    sentences = _sums(np.isin(last, np.frombuffer(b".!?", np.uint8)), words.first) / many
    short = _sums(words.end - words.start <= 3, words.first) / many
    lines, again = _dup_lines(words, hashes, text)

    def vote(bad: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
        return np.where(bad, -1, 0 if good is None else np.where(good, 1, 0))

    return np.stack([
        vote(n < 3, n >= 10),
        vote(symbols > 0.3),
        vote((repeats > 0.2) & (n >= 10)),
        vote((distinct < 0.35) & some),
        vote((sentences < 0.01) & some, (sentences > 0.02) & (sentences < 0.5) & (n >= 3)),
        vote((again >= 3) & (10 * again > 3 * lines)),
        vote((short < 0.08) & some, (short > 0.08) & (short < 0.9) & (n >= 3)),
        vote(bars > 0.1),
    ], 1)


def pattern(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def unpattern(codes: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(labellers) % 3 - 1


@dataclass
class LabelModel:
    """Share of good documents, and the rates of each labeller's votes (bad, abstain, good) by class (bad, good)."""

    good: float
    rates: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        logs = np.log(self.rates)
        score = np.stack([logs[np.arange(v.shape[1]), c][np.arange(v.shape[1]), v + 1].sum(1) for c in (0, 1)], 1)
        score += np.log([1 - self.good, self.good])
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def estimate(codes: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns, starting from :data:`START` for every labeller."""
    v = unpattern(codes, labellers)
    start = START
    model = LabelModel(0.8, np.repeat(start[None], labellers, 0))
    for _ in range(rounds if len(codes) else 0):
        good = model.posterior(v)
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.stack([[[weight[c][v[:, j] == x].sum() for x in (-1, 0, 1)] for c in (0, 1)] for j in range(labellers)])
        rates += start[None] * max(1.0, 0.001 * counts.sum())  # a prior keeps every rate above zero and the classes apart
        rates /= rates.sum(2, keepdims=True)
        share = float(np.clip(weight[1].sum() / counts.sum(), 0.01, 0.99))
        done = np.abs(rates - model.rates).max() < 1e-6
        model = LabelModel(share, rates)
        if done:
            break
    return model


def features(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of the hashed features; a text's values have unit length.

    Slots hash words, word shapes (length, last byte, first byte's class), shape pairs, and
    whether a word repeats the one before.
    """
    if not len(words):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    text = words.text_of_word()
    length = np.minimum(words.end - words.start, 20).astype(np.uint64)
    last = words.data[words.end - 1].astype(np.uint64)
    letter = (words.data[words.start] >= 0x61).astype(np.uint64)
    shape = mix((length << np.uint64(16)) | (last << np.uint64(1)) | letter)
    follows = text[1:] == text[:-1]
    pair = mix(mix(shape[:-1]) + shape[1:])[follows]
    again = ((hashes[1:] == hashes[:-1]) & follows).astype(np.uint64)[follows]
    keys = np.concatenate([mix(hashes ^ np.uint64(1)), mix(shape ^ np.uint64(2)), mix(pair ^ np.uint64(3)), mix(again + np.uint64(99))])
    owner = np.concatenate([text, text, text[1:][follows], text[1:][follows]])
    slot = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    both, count = np.unique((owner << BITS) | slot, return_counts=True)
    owner, slot, value = both >> BITS, both & ((1 << BITS) - 1), np.sqrt(count)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=len(words.first) - 1))
    return owner, slot, value / norm[owner]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 200, rate: float = 4.0) -> np.ndarray:
    """Logistic weights and, last, the bias from soft targets, both classes weighed alike; accelerated gradient descent."""
    model = np.zeros((1 << BITS) + 1)
    if not len(rows):
        return model
    owner = np.repeat(np.arange(len(rows)), [len(slot) for slot, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]).astype(int), np.concatenate([v for _, v in rows])
    share = float(np.clip(target.mean(), 0.02, 0.98))
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))
    ahead, last = model.copy(), model
    for step in range(rounds):
        line = np.bincount(owner, value * ahead[slot], minlength=len(rows)) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(line, -500, 500))) - target) / len(rows)
        slope = np.append(np.bincount(slot, value * error[owner], minlength=1 << BITS), error.sum()) + 1e-5 * ahead
        last, model = model, ahead - rate * slope
        ahead = model + step / (step + 3) * (model - last)
    return model


def _each_slice(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    for batch in batches:
        for begin, end in slices(batch.column(column)):
            part = batch.slice(begin, end - begin)
            words = words_of(part.column(column), SPACED)
            yield part, words, words.hashes()


def label_model(docs: DataFrame, text: str = "text") -> LabelModel:
    """Estimate the labellers over all documents; what reaches the driver is one row per vote pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, hashes in _each_slice(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(words, hashes)), pa.int64())], ["code"])

    rows = docs.select(text).mapInArrow(run, "code bigint").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: r["code"])
    return estimate(np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float))


def scorer(docs: DataFrame, labels: LabelModel, text: str = "text", fit_docs: int = FIT_DOCS) -> np.ndarray:
    """Fit the hashed linear scorer on at most ``fit_docs`` documents of the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, hashes in _each_slice(batches, 0):
            owner, slot, value = features(words, hashes)
            cuts = np.searchsorted(owner, np.arange(1, part.num_rows))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.split(slot, cuts), pa.list_(pa.int64())), pa.array(np.split(value, cuts), pa.list_(pa.float64())),
                pa.array(labels.posterior(votes(words, hashes)))], ["slot", "value", "good"])

    sample = spread(docs, fit_docs).select(text).mapInArrow(run, "slot array<bigint>, value array<double>, good double").collect()
    sample = [sample[i] for i in even(len(sample), fit_docs)]
    return fit_scorer([(np.array(r["slot"], int), np.array(r["value"], float)) for r in sample], np.array([r["good"] for r in sample]))


def classify(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the weak label's posterior, the scorer's probability and the verdict (kept from 0.5 on).

    New columns replace those of the same name; ``prefix`` keeps them apart.
    """
    labels = label_model(docs, text)
    weights = scorer(docs, labels, text)
    index = docs.columns.index(text)
    names = [f"{prefix}{n}" for n in ("posterior", "score", "kept")]
    kinds = [T.DoubleType(), T.DoubleType(), T.BooleanType()]
    added = Added(docs, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, hashes in _each_slice(batches, index):
            owner, slot, value = features(words, hashes)
            line = np.bincount(owner, value * weights[slot], minlength=part.num_rows) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(line, -500, 500)))
            good = labels.posterior(votes(words, hashes))
            yield added.batch(part, [pa.array(good), pa.array(score), pa.array(score >= KEEP)])

    return docs.mapInArrow(run, added.schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: posterior of its weak label, score and verdict."""
    return classify(docs.select(key, text), text).drop(text)
