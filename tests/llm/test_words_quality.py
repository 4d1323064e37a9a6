"""Word slices, quality rules and decontamination against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from nodeloom.llm import contamination, quality
from nodeloom.llm.bytewords import ALNUM, SPACED, slices, words_of
from tests.llm import brute

rng = random.Random(3)
PIECES = ["a", "B", "the", "é", "日本", "12", " ", "\n", "\t", "|", "###", ".", "x" * 30, " ", "'", "\x00", "\x0b"]
TEXTS = [None, "", " \n\t", "word", "x" * 5000] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(80))) for _ in range(60)]
LONG = " ".join(f"w{i % 700}" for i in range(30_000))


def test_words_match_the_patterns():
    column = pa.array(TEXTS)
    for table, pattern in ((ALNUM, brute.ALNUM), (SPACED, brute.SPACED)):
        found = words_of(column, table)
        for i, text in enumerate(TEXTS):
            got = [found.word(k).decode() for k in range(found.first[i], found.first[i + 1])]
            want = pattern.findall((text or "").translate(brute.LOWER))
            if table is SPACED:
                want = [w for x in want for w in x.split("\x00") if w]
            assert got == want
        again = found.hashes()
        seen = {}
        for k in range(len(found)):
            assert seen.setdefault(found.word(k), again[k]) == again[k]
        assert len(set(seen.values())) == len(seen)


def test_slices_cover_rows_and_keep_a_long_text_alone():
    column = pa.array(["a" * 10, None, "b" * 100, "c", "d"])
    parts = list(slices(column, 12))
    assert parts[0][0] == 0 and parts[-1][1] == 5
    assert all(a[1] == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True))
    assert list(slices(pa.array([], pa.string()))) == []
    sliced = column.slice(2, 3)
    assert [words_of(sliced, SPACED).word(i)[:1] for i in range(3)] == [b"b", b"c", b"d"]


def table(spark, texts, extra=""):
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words int")


def test_quality_matches_plain_version(spark):
    lines = "one line of words here\n" * 12
    texts = [*TEXTS, LONG, lines, "%%% a " * 30, "a b c d e f g h i j k l m n o p", "same words again and again " * 20]
    got = quality.report(table(spark, texts).drop("doc_id").withColumnRenamed("n_words", "doc_id")).collect()
    for row in got:
        text = texts[row["doc_id"]]
        if text == LONG:
            assert row["n_words"] == 30_000 and row["n_repeat_words"] == 30_000 and row["base_failed"]
        else:
            assert tuple(row)[1:] == brute.quality(text), repr(text)


def test_quality_keeps_columns_with_clashing_names(spark):
    clean = " ".join(f"word{i}" for i in range(30)) + "."
    docs = table(spark, ["short", clean, clean, None])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert [r["text"] for r in kept.collect()] == [clean, clean]
    assert quality.keep(docs.limit(0)).count() == 0
    assert quality.report(docs.limit(0)).count() == 0


def test_order_never_changes_a_verdict(spark):
    docs = table(spark, TEXTS).withColumn("w", quality.words_of("text"))
    rules = quality.production_rules()
    a = docs.select("n_words", quality.verdict(rules, quality.Counts.of(docs["w"], "text")).alias("k")).collect()
    b = docs.select("n_words", quality.verdict(rules[::-1], quality.Counts.of(docs["w"], "text")).alias("k")).collect()
    assert a == b
    stats = [quality.RuleStats("few_words", 0.1, 0.0), quality.RuleStats("symbols", 0.1, 0.5), quality.RuleStats("repeated_windows", 2.0, 0.5),
             quality.RuleStats("repeated_lines", 0.2, 0.5), quality.RuleStats("letter_spacing", 0.1, 0.1)]
    assert [r.name for r in quality.ordered(rules, stats)] == ["symbols", "repeated_lines", "letter_spacing", "repeated_windows", "few_words"]


def vocabulary(n, k):
    return " ".join(f"v{rng.randrange(n)}" for _ in range(k))


@pytest.mark.parametrize("shortest", [1, 3, 13])
def test_decontamination_matches_plain_version(spark, shortest):
    items = [(i, vocabulary(6, rng.randrange(shortest, 30))) for i in range(12)]
    items += [(3, items[4][1]), (None, vocabulary(6, 20)), (40, None), (41, "... !"), (42, items[0][1] + " tail of the other")]
    texts = [None, "", "...", items[0][1].upper(), "x " + items[1][1] + " y"] + [vocabulary(6, rng.randrange(60)) for _ in range(40)]
    texts += [f"{vocabulary(5000, 60)} {items[i][1]}, {vocabulary(5000, 200)}" for i in range(6)] + [items[2][1] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for chars in (1_000_000, 200):
        found = contamination.find(docs, bench, block_chars=chars, window=13).collect()
        assert len(found) == len(texts)
        for row in found:
            n, hit, ids, bad = brute.contamination(texts[row["doc_id"]], items)
            h = row["hits"]
            assert (h["n_words"], h["n_hit"], h["items"], h["contaminated"]) == (n, hit, ids, bad)
            assert sum(e - b for b, e in h["spans"]) == hit


def test_automaton_tracks_longest_matches():
    items = [vocabulary(4, 40).encode().split() for _ in range(5)]
    automaton = contamination.SuffixAutomaton()
    for words in items:
        automaton.add(words)
    text = vocabulary(5, 300).encode().split()
    joined = [" ".join(w.decode() for w in x) + " " for x in items]
    for k, (_, length) in enumerate(automaton.walk(text, 13)):
        best = 0
        for n in range(1, 41):
            part = " ".join(w.decode() for w in text[max(0, k + 1 - n):k + 1]) + " "
            if n <= k + 1 and any((" " + j).find(" " + part) >= 0 for j in joined):
                best = n
        assert length == best


def test_decontamination_removes_documents_or_spans(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = " ".join(f"z{i}" for i in range(600))
    texts = [item, f"{long} {item} end", long, None]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id bigint, text string, hits string, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = contamination.clean(docs, bench).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == texts[1:]
    cut = contamination.clean(docs, bench, cut_spans=True).orderBy("doc_id").collect()
    assert [r["text"] for r in cut] == [f"{long}  end", long, None]
    assert contamination.clean(docs, bench.limit(0)).count() == 4
    assert contamination.report(docs.limit(0), bench).count() == 0


def test_long_text_is_one_slice():
    found = words_of(pa.array([LONG]), ALNUM)
    assert len(found) == 30_000 and np.array_equal(found.first, [0, 30_000])
