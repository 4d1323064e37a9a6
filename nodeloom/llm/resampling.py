"""Resampling a corpus towards a target distribution of hashed word runs.

Features are all runs of 1 to ``max_n`` consecutive words, hashed by CRC-32 into buckets; the CRCs
come from one scan of each text (``prefixcrc``). The counts of the corpus and of the target give each
bucket a gain, the log ratio of its smoothed shares in thousandths. A document's weight is the
floored mean gain of its features, its score adds Gumbel noise drawn from its key, and the documents
with the highest scores are an importance sample without replacement.

Counts cover every row: each task adds up its own buckets, so what is shuffled is bounded by the
buckets and not by the text. Only the bucket totals reach the driver.

Defined results: null and empty texts have no features, weight 0 and are never drawn while
``min_words`` is positive; a null key is drawn as an empty one and comes last among equal scores;
repeated rows count and rank one by one. New columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import ALNUM, slices, words_of
from nodeloom.llm.columns import Added
from nodeloom.llm.prefixcrc import PrefixCrcs
from nodeloom.plans.scan import global_rank
from nodeloom.plans.store import Saved, save

BUCKETS = 10_000
MAX_N = 2
MIN_WORDS = 20
SHARE = 25  # of 100 eligible documents
SEED = 7


@dataclass
class Features:
    """Hashed features of a slice of texts: ``bucket[i]`` belongs to ``text[i]``, texts in order."""

    n_words: np.ndarray
    runs: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(column: pa.Array, buckets: int, max_n: int) -> Features:
        words = words_of(column, ALNUM)
        crcs = PrefixCrcs(words)
        runs = [crcs.runs(size) for size in range(1, max_n + 1)]
        return Features(np.diff(words.first), [((crc % np.uint32(buckets)).astype(np.int64), text) for crc, text in runs])

    def total(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and their summed gains per text."""
        n, gained = np.zeros(len(self.n_words), np.int64), np.zeros(len(self.n_words), np.int64)
        for bucket, text in self.runs:
            edge = np.searchsorted(text, np.arange(len(n) + 1))
            running = np.concatenate([[0], np.cumsum(gains[bucket])])
            n += np.diff(edge)
            gained += np.diff(running[edge])
        return n, gained


def bucket_counts(docs: DataFrame, text: str = "text", *, buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(bucket, n) over the features of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for begin, end in slices(batch.column(0)):
                for bucket, _ in Features.of(batch.column(0).slice(begin, end - begin), buckets, max_n).runs:
                    counts += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    per_task = docs.select(F.col(text)).mapInArrow(run, "bucket bigint, n bigint")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratio of each bucket's smoothed shares in target and source, in thousandths."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = [float(t + 1) * float(all_source + n) / (float(s + 1) * float(all_target + n))
             for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([floor(1000 * log(r)) for r in ratio], np.int64)


def learn(docs: DataFrame, target: DataFrame, text: str = "text", *, buckets: int = BUCKETS, max_n: int = MAX_N) -> np.ndarray:
    """The gain of each bucket, from all texts of both tables."""
    source, wanted = (_dense(bucket_counts(t, text, buckets=buckets, max_n=max_n), buckets) for t in (docs, target))
    return gains_of(source, wanted)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def scored(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", *, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    names = ["n_words", "n_features", "weight"]
    added, index, buckets = Added(docs, [T.StructField(n, T.LongType()) for n in names]), docs.columns.index(text), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(index)):
                part = batch.slice(begin, end - begin)
                found = Features.of(part.column(index), buckets, max_n)
                n, gained = found.total(gains)
                yield added.batch(part, [pa.array(x, pa.int64()) for x in (found.n_words, n, gained // np.maximum(n, 1))])

    return docs.mapInArrow(run, added.schema).withColumn("score", F.col("weight") + noise(F.col(key), seed))


@dataclass
class Draw:
    """Scored keys with their rank; ``drawn`` rows have one, in order of falling score."""

    ranked: DataFrame
    drawn: int
    kept: Saved


def draw(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", *, share: int = SHARE, min_words: int = MIN_WORDS,
         max_n: int = MAX_N, seed: int = SEED) -> Draw:
    """The ``share`` percent of documents of ``min_words`` words or more that score highest.

    Only keys and figures are sorted, by range, so one score of very many documents is cut too.
    """
    figures = scored(docs.select(key, text), gains, key, text, max_n=max_n, seed=seed).drop(text)
    table = save(figures.withColumn("_open", F.col("n_words") >= min_words), "scored")
    drawn = share * table.df.filter("_open").count() // 100
    order = [F.desc("_open"), F.desc("score"), F.asc_nulls_last(key)]
    place = global_rank(table.df, order, "_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    return Draw(place.withColumn("rank", rank).drop("_place", "_open"), drawn, table)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", *, share: int = SHARE,
             min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """The drawn documents themselves, with their figures.

    The texts are not shuffled: the last drawn score and key are the limit of a filter. Rows that
    equal the last drawn one in score and key all stay.
    """
    gains = learn(docs, target, text, buckets=buckets, max_n=max_n)
    result = draw(docs, gains, key, text, share=share, min_words=min_words, max_n=max_n, seed=seed)
    rows = scored(docs, gains, key, text, max_n=max_n, seed=seed)
    if not result.drawn:
        return rows.filter(F.lit(False))
    last = result.ranked.filter(F.col("rank") == result.drawn).first()
    name = F.col(key)
    tie = F.lit(True) if last[key] is None else name <= F.lit(last[key])
    inside = (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(tie, F.lit(False)))
    return rows.filter((F.col("n_words") >= min_words) & inside)


def report(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's key, n_features, weight, score and rank (null when it is not drawn)."""
    gains = learn(docs, target, text)
    return draw(docs, gains, key, text).ranked.select(key, "n_features", "weight", F.col("score").cast("bigint").alias("score"), "rank")
