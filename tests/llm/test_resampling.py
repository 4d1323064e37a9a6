"""Prefix CRCs and resampling against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nodeloom.llm import prefixcrc, resampling
from nodeloom.llm.bytewords import ALNUM, words_of
from tests.llm import brute

rng = random.Random(11)
VOCABULARY = ["The", "é", "日本", "cat", "12", "x" * 70, "sat", "on", "Ärger"]
TEXTS = [None, "", " .,\n", "one", "y" * 5000 + " z"] + [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(60))) + "." for _ in range(60)]
TARGET = ["the cat sat on the cat", None, "cat cat"]


def features(text, max_n):
    w = brute.words(text)
    return [" ".join(w[i:i + n]).encode() for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_version(docs, target, buckets=10_000, share=25, min_words=20, seed=7):
    """Sorted (id, n_features, weight, score, rank)."""
    source, wanted = np.zeros(buckets, int), np.zeros(buckets, int)
    for text in (t for _, t in docs):
        for f in features(text, 2):
            source[zlib.crc32(f) % buckets] += 1
    for text in target:
        for f in features(text, 2):
            wanted[zlib.crc32(f) % buckets] += 1
    rows = []
    for key, text in docs:
        fs = features(text, 2)
        gain = 0
        for f in fs:
            b = zlib.crc32(f) % buckets
            gain += math.floor(1000 * math.log((wanted[b] + 1) * (source.sum() + buckets) / ((source[b] + 1) * (wanted.sum() + buckets))))
        weight = gain // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(fs), weight, score, None, len(brute.words(text)) >= min_words])
    open_rows = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(open_rows[:share * len(open_rows) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("size", [1, 2, 3])
@pytest.mark.parametrize("scan", [7, 1 << 17])
def test_run_crcs(size, scan, monkeypatch):
    monkeypatch.setattr(prefixcrc, "SCAN_WORDS", scan)
    crc, text = prefixcrc.PrefixCrcs(words_of(pa.array(TEXTS), ALNUM)).runs(size)
    want = [(t, zlib.crc32(" ".join(w[i:i + size]).encode())) for t, w in enumerate(map(brute.words, TEXTS)) for i in range(len(w) - size + 1)]
    assert list(zip(text.tolist(), crc.tolist(), strict=True)) == want


def test_shift_is_appending_zero_bytes():
    sizes = np.array([0, 1, 5, 63, 64, 65, 1000, 123_457])
    head, tail = b"some bytes", [b"\x07" * n for n in sizes]
    got = prefixcrc.shift(np.full(len(sizes), zlib.crc32(head), np.uint32), sizes)
    assert [int(g) ^ zlib.crc32(t) for g, t in zip(got, tail, strict=True)] == [zlib.crc32(head + t) for t in tail]


def test_report_matches_plain_version(spark):
    docs = [(None if i == 9 else i, t) for i, t in enumerate(TEXTS)]
    docs += [docs[20], docs[20], (3, TEXTS[30])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = sorted((tuple(r) for r in resampling.report(table, target).collect()), key=str)
    want = plain_version(docs, TARGET)
    assert sum(r[4] is not None for r in want) > 5
    # equal rows are ranked in any order
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    single = {r for r in want if [x[0] for x in want].count(r[0]) == 1}
    assert single <= set(got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id bigint, text string")
    none = docs.limit(0).select("text")
    assert resampling.report(docs.limit(0), none).count() == 0
    (row,) = resampling.report(docs, none).collect()
    assert tuple(row) == plain_version([(1, "a b c " * 10)], [])[0]
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, none).count() == 0  # a quarter of one document is none


def test_resample_returns_the_drawn_documents(spark):
    rows = [(i, t, "mine", 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Score string, extra int")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, share=40)
    assert sorted(got.columns) == sorted(["doc_id", "text", "extra", "n_words", "n_features", "weight", "score"])
    want = {r[0]: r for r in plain_version([r[:2] for r in rows], TARGET, share=40) if r[4]}
    found = got.collect()
    assert {r["doc_id"] for r in found} == set(want) and all(r["text"] == TEXTS[r["doc_id"]] for r in found)
    assert all((r["n_features"], r["weight"], r["score"]) == want[r["doc_id"]][1:4] for r in found)


def test_weights_lean_to_the_target(spark):
    near = [(i, "the cat sat on the mat with the other cat near the door of the house on the hill by the sea ok") for i in range(30)]
    far = [(100 + i, " ".join(rng.choice("abcdefghijklm") * 3 for _ in range(25))) for i in range(90)]
    docs = spark.createDataFrame(near + far, "doc_id bigint, text string")
    target = spark.createDataFrame([(near[0][1],)] * 20, "text string")
    drawn = resampling.report(docs, target).filter("rank is not null")
    assert drawn.filter("doc_id < 100").count() >= 22 and drawn.count() == 30  # without weights about 7
