"""Quality rules: a short-circuit cascade of native column expressions.

The cost and the rejection rate of each rule are measured on a bounded sample, and rules run
in falling order of rejections per second of cost. The order decides only how much work is
done, never a verdict: a document is kept when no rule rejects it.

Defined results: null text has no words and fails the word-count rule; nulls in other columns,
repeated rows and extra columns pass through untouched (internal columns carry a prefix no
table should use). An empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
#: Rows of the sample that costs and rejection rates are measured on.
SAMPLE_ROWS = 2000
_WORDS = "__nl_q_words"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), "")


def lines_of(text: str) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def n_words(words: Column) -> Column:
    return F.size(words).cast("bigint")


def word_chars(words: Column) -> Column:
    return F.length(F.concat_ws("", words)).cast("bigint")


def n_symbols(text: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SYMBOLS, "")).cast("bigint")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def n_repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Window hashes tell in linear time whether any window can repeat. Only then are windows
    sorted with their text, so that a hash collision cannot count.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    parts = [lambda i, k=k: F.get(words, i + k) for k in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*[p(i) for p in parts]))
    collide = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[p(i) for p in parts]).alias("h"), F.concat_ws(" ", *[p(i) for p in parts]).alias("w"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["w"] == b["w"]), F.lit(False))

    def covered(sorted_windows: Column) -> Column:
        repeated = F.filter(sorted_windows, lambda x, k: same(x, F.get(sorted_windows, k - 1)) | same(x, F.get(sorted_windows, k + 1)))
        at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, first, lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    many = F.size(words) > WINDOW
    return F.when(many & F.when(many, collide).otherwise(False), _let(windows, covered)).otherwise(0).cast("bigint")


@dataclass(frozen=True)
class Counts:
    """The counts that rules read, as columns: expressions over a text, or columns that hold them."""

    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, words: Column, text: str) -> Counts:
        return cls(n_words(words), word_chars(words), n_symbols(text), F.size(lines_of(text)).cast("bigint"),
                   _let(lines_of(text), n_dup_lines), n_repeat_words(words))

    @classmethod
    def stored(cls) -> Counts:
        return cls(*[F.col(f.name) for f in fields(cls)])


@dataclass(frozen=True)
class Rule:
    """A rule rejects where its predicate over the counts is true; the predicate is never null."""

    name: str
    rejects: Callable[[Counts], Column]


def production_rules() -> list[Rule]:
    """The base rules (few words, repeated windows) and the method's own."""
    return [
        Rule("few_words", lambda c: c.n_words < 10),
        Rule("repeated_windows", lambda c: 100 * c.n_repeat_words > 20 * c.n_words),
        Rule("symbols", lambda c: 10 * c.n_symbols > 3 * c.n_words),
        Rule("repeated_lines", lambda c: (c.n_dup_lines >= 3) & (10 * c.n_dup_lines > 3 * c.n_lines)),
        Rule("letter_spacing", lambda c: 2 * c.word_chars < 3 * c.n_words),
    ]


@dataclass(frozen=True)
class RuleStats:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-4)


def measure(docs: DataFrame, text: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[RuleStats]:
    """Cost above a bare split, and share of rejected rows, of each rule on a bounded sample.

    The sample is what the first partitions hold, read one after another until there are enough
    rows: no shuffle and no scan of the table, whatever its size.
    """
    split = docs.select(F.col(text)).withColumn(_WORDS, words_of(text))
    counts = Counts.of(F.col(_WORDS), text)

    def timed(rejects: Callable[[Counts], Column]) -> tuple[float, float]:
        begin = time.perf_counter()
        rows = split.select(rejects(counts).alias("hit"), F.size(_WORDS).alias("n")).head(sample_rows)
        return time.perf_counter() - begin, sum(r["hit"] for r in rows) / max(len(rows), 1)

    def nothing(c: Counts) -> Column:
        return c.n_words < 0

    timed(nothing)
    bare, _ = timed(nothing)
    out = []
    for rule in rules:
        seconds, share = timed(rule.rejects)
        out.append(RuleStats(rule.name, max(seconds - bare, 1e-4), share))
    return out


def ordered(rules: Sequence[Rule], stats: Sequence[RuleStats]) -> list[Rule]:
    gain = {s.name: s.gain for s in stats}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def verdict(rules: Sequence[Rule], counts: Counts) -> Column:
    """True for kept documents; later rules are not evaluated once one rejects."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.rejects(counts), F.lit(False)).otherwise(kept)
    return kept


def cascade(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None) -> list[Rule]:
    """The rules in the order measured on a sample of ``docs``."""
    rules = list(rules or production_rules())
    return ordered(rules, measure(docs, text, rules))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents that no rule rejects, with the columns of ``docs``.

    The predicate splits the text itself and binds the words once, so it stays whole wherever
    the optimiser moves it, and a count is made only when the cascade reaches its rule.
    """
    rules = cascade(docs, text)
    return docs.filter(_let(words_of(text), lambda words: verdict(rules, Counts.of(words, text))))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, the base verdict and the cascade's verdict.

    All counts are returned here, so the cascade reads the columns that hold them.
    """
    own = docs.select(F.col(key).alias("__nl_q_key"), F.col(text).alias("__nl_q_text"))
    rules = cascade(own, "__nl_q_text")
    counts = Counts.of(F.col(_WORDS), "__nl_q_text")
    counted = own.withColumn(_WORDS, words_of("__nl_q_text")).select(
        F.col("__nl_q_key").alias(key), *[getattr(counts, f.name).alias(f.name) for f in fields(Counts)])
    held = Counts.stored()
    failed = (held.n_words < 10) | (100 * held.n_repeat_words > 20 * held.n_words)
    return counted.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        verdict(rules, held).alias("kept"))
