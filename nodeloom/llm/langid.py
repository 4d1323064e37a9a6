"""Language of every word of code-switched text by a linear-chain conditional random field.

A word is a run of letters and marks. Its features are hashed affixes (the first and the last one
to three letters), the mean of its hashed two- and three-letter grams, and its shares in a lexicon:
how a frequent word divides over the languages of the training texts. A chain is one text;
transitions between the languages of neighbouring words are learned, and forward-backward
(``chain``) gives each word's marginals. A text's language is the one with the largest mean
marginal, the score is that mean.

Training: only rows with a language and a letter count. The lexicon counts the words of all of them.
The weights are fitted by gradient steps on a bounded sample, ``FIT_WORDS`` words in runs of at most
``RUN_WORDS`` drawn by hash, the same share for each language. A training label belongs to a whole
text, so chains that switch are made by joining pieces of runs in random order.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is
every text when there is nothing to learn from; ties go to the language that sorts first; equal texts get
equal results. New columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import mix, slices
from nodeloom.llm.chain import Marginals, forward_backward
from nodeloom.llm.columns import Added
from nodeloom.plans.store import save

UNKNOWN = "und"

SLOT_BITS = 16
#: Words of the sample that the weights are fitted on, all languages together.
FIT_WORDS = 80_000
#: Words that one text gives to the sample at most, and letters of them.
RUN_WORDS, RUN_LETTERS = 50, 600
#: Runs are cut into pieces of up to so many words, which are joined in random order.
PIECE_WORDS = 25
#: Frequent words of a language that enter the lexicon, at most.
LEXICON_WORDS = 5_000
#: A lexicon word occurs so often at least.
LEXICON_LEAST = 5
STEPS, RATE, RIDGE = 60, 0.15, 1e-4

#: Decimals of a score; further ones would depend on the texts that share a batch.
DIGITS = 9

SLICE_BYTES = 2 << 20
CHUNK_WORDS = 1 << 16

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SALTS = {(kind, size): np.uint64(0x27D4EB2F165667C5 * (3 * i + size) & (2**64 - 1))
          for i, kind in enumerate(("prefix", "suffix", "gram"), 1) for size in (1, 2, 3)}


@dataclass
class Tokens:
    """Words of several texts: code points ``letters[start[i]:end[i]]``, text ``t`` has words ``first[t]..first[t+1]``."""

    letters: np.ndarray
    begin: np.ndarray  # of each text
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Tokens:
        """Lower-cased words; other characters keep their place, so positions are those of the text."""
        plain = pc.replace_substring_regex(pc.fill_null(column, ""), r"[^\p{L}\p{M}]", " ")
        texts = pc.utf8_lower(plain).to_pylist()
        letters = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), "<u4")
        inside = letters > 32
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.concatenate([[0], np.flatnonzero(letters == 10) + 1]) if texts else np.zeros(0, np.int64)
        first = np.concatenate([np.searchsorted(start, begin), [len(start)]])
        return Tokens(letters, begin, start, end, first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word, a sum over its letters in their places."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        low, high = self.start[0], self.end[-1]
        place = np.arange(high - low) - np.repeat(self.start - low, np.diff(np.concatenate([self.start - low, [high - low]])))
        value = mix(self.letters[low:high].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)))
        value[self.letters[low:high] <= 32] = 0
        return np.add.reduceat(value, self.start - low)


def _slots(letters: np.ndarray, at: np.ndarray, kind: str, size: int) -> np.ndarray:
    value = np.full(len(at), _SALTS[kind, size])
    for i in range(size):
        value += letters[at + i].astype(np.uint64) * _MULTIPLIERS[i]
    value ^= value >> np.uint64(31)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return (value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slots_of(tokens: Tokens, low: int, high: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of words ``low`` to ``high``: (words, slots) of each affix, then word and slot of every gram, words in order."""
    start, end = tokens.start[low:high], tokens.end[low:high]
    size = end - start
    affixes, words, grams = [], [], []
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n)
        affixes.append((long, _slots(tokens.letters, start[long], "prefix", n)))
        affixes.append((long, _slots(tokens.letters, end[long] - n, "suffix", n)))
        if n == 1:
            continue
        many = size[long] - n + 1
        word = np.repeat(long, many)
        at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        words.append(word)
        grams.append(_slots(tokens.letters, at, "gram", n))
    return affixes, np.concatenate(words), np.concatenate(grams)


@dataclass
class Model:
    """Languages, hashed weights (slot, language), lexicon shares and weights, transitions."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    shares: np.ndarray  # of each lexicon word over the languages
    trust: np.ndarray  # weights of the shares
    start: np.ndarray
    move: np.ndarray

    @staticmethod
    def blank(langs: list[str], lexicon: np.ndarray, shares: np.ndarray) -> Model:
        n = len(langs)
        return Model(langs, np.zeros((1 << SLOT_BITS, n), np.float32), lexicon, shares, np.zeros((n, n)), np.zeros(n), np.zeros((n, n)))

    def shares_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.langs)))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == hashes)[:, None], self.shares[at], 0.0)

    def unary(self, tokens: Tokens) -> np.ndarray:
        out = self.shares_of(tokens.hashes()) @ self.trust
        for low in range(0, len(tokens.start), CHUNK_WORDS):
            high = min(low + CHUNK_WORDS, len(tokens.start))
            affixes, word, gram = slots_of(tokens, low, high)
            for some, slot in affixes:
                out[low + some] += self.weights[slot]
            count = np.maximum(np.bincount(word, minlength=high - low), 1)
            for label in range(len(self.langs)):
                out[low:high, label] += np.bincount(word, self.weights[gram, label], high - low) / count
        return out

    def marginals(self, tokens: Tokens) -> Marginals:
        fresh = np.zeros(len(tokens.start), bool)
        fresh[tokens.first[:-1][np.diff(tokens.first) > 0]] = True
        return forward_backward(self.unary(tokens), self.start, self.move, fresh)


def fit(texts: list[list[str]], labels: list[list[str]], lexicon: np.ndarray, shares: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """Weights for chains of words with known labels, by full gradient steps with adaptive rates."""
    model = Model.blank(langs, lexicon, shares)
    tokens = Tokens.of(pa.array([" ".join(t) for t in texts], pa.string()))
    code = {lang: i for i, lang in enumerate(langs)}
    truth = np.array([code[x] for chain in labels for x in chain], np.int64)
    n, many = len(truth), len(langs)
    assert n == len(tokens.start), "a training word is not one run of letters"
    if not n:
        return model
    fresh = np.zeros(n, bool)
    fresh[tokens.first[:-1][np.diff(tokens.first) > 0]] = True
    affixes, word, gram = slots_of(tokens, 0, n)
    count = np.maximum(np.bincount(word, minlength=n), 1)
    rows = np.concatenate([*(w for w, _ in affixes), word])
    used, slot = np.unique(np.concatenate([*(s for _, s in affixes), gram]), return_inverse=True)
    value = np.concatenate([np.ones(sum(len(w) for w, _ in affixes)), 1.0 / count[word]])
    by_row, by_slot = np.argsort(rows, kind="stable"), np.argsort(slot, kind="stable")
    row_edge = np.searchsorted(rows[by_row], np.arange(n))  # every word has a letter, so a prefix
    slot_edge = np.searchsorted(slot[by_slot], np.arange(len(used)))
    seen = model.shares_of(tokens.hashes())
    onehot = np.zeros((n, many))
    onehot[np.arange(n), truth] = 1
    pairs = np.zeros((many, many))
    np.add.at(pairs, (truth[:-1][~fresh[1:]], truth[1:][~fresh[1:]]), 1)

    theta = [np.zeros((len(used), many)), np.zeros((many, many)), np.zeros(many), np.zeros((many, many))]
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        weights, trust, start, move = theta
        unary = np.add.reduceat(weights[slot[by_row]] * value[by_row][:, None], row_edge, axis=0) + seen @ trust
        got = forward_backward(unary, start, move, fresh)
        gap = got.word - onehot
        slope = [np.add.reduceat(gap[rows[by_slot]] * value[by_slot][:, None], slot_edge, axis=0), seen.T @ gap, gap[fresh].sum(axis=0), got.pair - pairs]
        for i, (t, g) in enumerate(zip(theta, slope, strict=True)):
            g = g / n + RIDGE * t
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            t -= RATE * (mean[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.99 ** step)) + 1e-8)
    model.weights[used] = theta[0]
    model.trust, model.start, model.move = theta[1:]
    return model


def chains(runs: list[tuple[str, list[str]]], seed: int = 7) -> tuple[list[list[str]], list[list[str]]]:
    """Code-switched chains of words and labels from runs of single languages."""
    rng = np.random.default_rng(seed)
    pieces = []
    for lang, words in sorted(runs):
        at = 0
        while at < len(words):
            size = int(rng.integers(1, PIECE_WORDS + 1))
            pieces.append((lang, words[at:at + size]))
            at += size
    texts: list[list[str]] = []
    labels: list[list[str]] = []
    left = 0
    for i in rng.permutation(len(pieces)).tolist():
        if not left:
            texts.append([])
            labels.append([])
            left = int(rng.integers(1, 6))
        left -= 1
        texts[-1] += pieces[i][1]
        labels[-1] += [pieces[i][0]] * len(pieces[i][1])
    return texts, labels


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n): how often each hashed word occurs in the texts of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                tokens = Tokens.of(part.column(0))
                hashes = tokens.hashes().view(np.int64)
                codes = part.column(1).dictionary_encode()
                code = np.repeat(codes.indices.to_numpy(), np.diff(tokens.first))
                for i, name in enumerate(codes.dictionary.to_pylist()):
                    word, n = np.unique(hashes[code == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(word), pa.string()), pa.array(word), pa.array(n)], ["lang", "word", "n"])

    per_slice = docs.select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, word bigint, n bigint")
    return per_slice.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _class(n: Column) -> Column:
    """Eight classes per doubling."""
    return F.floor(8 * F.log2(n)).cast("int")


def lexicon_of(docs: DataFrame, text: str, lang: str, langs: list[str], most: int = LEXICON_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each language's most frequent words and how they divide over the languages.

    Frequencies fall into classes; a language takes its highest classes as long as they hold at most
    ``most`` words. Only these words reach the driver.
    """
    counts = save(word_counts(docs, text, lang).filter(F.col("n") >= LEXICON_LEAST), "lexicon")
    sizes = counts.df.groupBy("lang", _class(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit: dict[str, int] = {}
    taken: dict[str, int] = {}
    for row in sorted(sizes, key=lambda r: -r["c"]):  # a few hundred classes a language
        taken[row["lang"]] = taken.get(row["lang"], 0) + row["n"]
        if taken[row["lang"]] <= most:
            limit[row["lang"]] = row["c"]
    if not limit:
        counts.drop()
        return np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    least = F.create_map(*[x for name, c in limit.items() for x in (F.lit(name), F.lit(c))])
    frequent = counts.df.filter(_class(F.col("n")) >= least[F.col("lang")])
    found = frequent.select("word").distinct().join(counts.df, "word").toPandas()  # at most ``most`` words a language, a row per language
    counts.drop()
    words, at = np.unique(found["word"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    table = np.zeros((len(words), len(langs)))
    code = {name: i for i, name in enumerate(langs)}
    np.add.at(table, (at, found["lang"].map(code).to_numpy(np.int64)), found["n"].to_numpy(float))
    table /= np.maximum(table.sum(axis=0), 1)
    return words, table / table.sum(axis=1, keepdims=True)


def runs_of(docs: DataFrame, text: str, lang: str, sizes: dict[str, int], words: int = FIT_WORDS) -> list[tuple[str, list[str]]]:
    """The bounded sample: a run of words of texts drawn by hash, about as many texts of each language."""
    texts = max(1, words // (RUN_WORDS * max(1, len(sizes))))
    draw = F.xxhash64(F.col(text), F.monotonically_increasing_id())
    part = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, texts / n)))])
    some = docs.filter(F.pmod(draw, F.lit(1 << 40)) < part[F.col(lang)] * float(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                tokens = Tokens.of(part.column(0))
                place, out = part.column(2).to_numpy(), []
                for t in range(part.num_rows):
                    a, b = int(tokens.first[t]), int(tokens.first[t + 1])
                    a += int(place[t]) % max(1, b - a - RUN_WORDS + 1)
                    run_words, letters = [], 0
                    for i in range(a, min(b, a + RUN_WORDS)):
                        word = tokens.letters[tokens.start[i]:tokens.end[i]][:RUN_LETTERS]
                        letters += len(word)
                        if run_words and letters > RUN_LETTERS:
                            break
                        run_words.append(word.tobytes().decode("utf-32-le"))
                    out.append(" ".join(run_words))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out, pa.string())], ["lang", "words"])

    place = F.pmod(F.shiftrightunsigned(draw, 40).cast("bigint"), F.lit(1 << 20))
    sample = some.select(F.col(text), F.col(lang), place.alias("_place")).mapInArrow(run, "lang string, words string")
    return [(r["lang"], r["words"].split(" ")) for r in sample.collect() if r["words"]]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", *, words: int = FIT_WORDS, steps: int = STEPS) -> Model | None:
    """A model of the languages in ``lang``; None when no row has both a language and a letter."""
    train = docs.select(F.col(text), F.col(lang)).filter(F.col(lang).isNotNull() & has_letter(F.col(text)))
    sizes = {r[lang]: r["count"] for r in train.groupBy(lang).count().collect()}  # one row per language
    if not sizes:
        return None
    langs = sorted(sizes)
    lexicon, shares = lexicon_of(train, text, lang, langs)
    texts, labels = chains(runs_of(train, text, lang, sizes, words))
    return fit(texts, labels, lexicon, shares, langs, steps)


RUNS = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _language_runs(tokens: Tokens, word: np.ndarray, langs: list[str]) -> pa.Array:
    """Per text the runs of words with one most likely language, as code points of the text."""
    label, n = word.argmax(axis=1), len(tokens.begin)
    text = np.repeat(np.arange(n), np.diff(tokens.first))
    head = np.ones(len(label), bool)
    head[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    tail = np.concatenate([at[1:], [len(label)]])[:len(at)] - 1
    base = tokens.begin[text[at]]
    values = pa.StructArray.from_arrays(
        [pa.array(np.array(langs, object)[label[at]], pa.string()), pa.array(tokens.start[at] - base), pa.array(tokens.end[tail] - base)],
        fields=list(_RUNS.value_type))
    edges = np.searchsorted(text[at], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def identify(docs: DataFrame, model: Model | None, text: str = "text", *, runs: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and with ``runs`` the spans of text in one language each."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    added, index = Added(docs, fields + ([T.StructField("runs", RUNS)] if runs else [])), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(index), SLICE_BYTES):
                part = batch.slice(begin, end - begin)
                if model is None:
                    none = [pa.array([UNKNOWN] * part.num_rows), pa.array([0.0] * part.num_rows)]
                    yield added.batch(part, none + ([pa.array([[]] * part.num_rows, _RUNS)] if runs else []))
                    continue
                tokens = Tokens.of(part.column(index))
                word = model.marginals(tokens).word
                total = np.concatenate([np.zeros((1, word.shape[1])), np.cumsum(word, axis=0)])
                size = np.diff(tokens.first)
                mean = np.round(np.diff(total[tokens.first], axis=0) / np.maximum(size, 1)[:, None], DIGITS)
                lettered = pc.match_substring_regex(pc.fill_null(part.column(index), ""), r"\p{L}").to_numpy(zero_copy_only=False)
                best = mean.argmax(axis=1)
                name = np.where(lettered, np.array(model.langs, object)[best], UNKNOWN)
                score = np.where(lettered, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                arrays = [pa.array(name, pa.string()), pa.array(score, pa.float64())]
                yield added.batch(part, arrays + ([_language_runs(tokens, word, model.langs)] if runs else []))

    return docs.mapInArrow(run, added.schema)


def held_out(key: Column, parts: int = 5) -> Column:
    """True for the fifth of the keys that nothing is learned from; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == 0


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every text's key, held_out, lang_pred and score, learned from the rows that are not held out."""
    model = learn(docs.filter(~held_out(F.col(key))), text, lang)
    found = identify(docs.select(key, text), model, text, runs=False)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
