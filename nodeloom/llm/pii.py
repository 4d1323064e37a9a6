"""Personal data in text: base patterns and a skip-chain conditional random field.

Base spans are pattern matches and are always reported. The field's nodes are the words that
hold a figure 0-9 or an at sign. Chain edges join neighbouring nodes; skip edges join consecutive
occurrences of equal or similar words anywhere in the document (same digits, same last seven
digits, same local part of an address), so that one clear occurrence decides for the unclear
ones. Potentials are fitted piecewise on a bounded sample labelled by the base patterns: node
weights by multinomial regression, edge potentials from label pairs. Loopy sum-product message
passing runs over all documents of a slice at once. A node run is added as a span when its
posterior is at least ``SURE`` and the text has the shape of its kind.

Defined results: null text is empty and has no spans; repeated rows are judged one by one;
without any labelled word in the table the field adds nothing; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.columns import Added
from nodeloom.llm.samples import even, share
from nodeloom.llm.spans import ROWS, SPANS, Span, count, joined, span_array

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
_RANK = {kind: i for i, kind in enumerate(KINDS)}
#: Words (with a figure 0-9 or at sign) the field is fitted on.
FIT_WORDS = 40_000
#: Part of them that one document gives at most.
_EACH = 100
SURE = 0.9
ROUNDS = 8

_ANY = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield "email", begin, done
        at = text.find("@", max(at + 1, done))


def _octets(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def plausible(kind: str, text: str) -> bool:
    """Whether a text the field labels has the shape of its kind."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        local, at, domain = text.partition("@")
        return bool(local and at and domain)
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _octets(tuple(parts))
    if kind == "card":
        return 15 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", text)
    return 7 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+-]", text)


@dataclass
class Graph:
    """Words of many documents as nodes, with their features and edges."""

    spot: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end
    features: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


#: Feature slots: fixed ones first, then hashed previous words.
_FIXED, _HASHED = 40, 64
WIDTH = _FIXED + _HASHED
_SIZES = (0, 2, 3, 4, 6, 8, 12, 15, 16, 19)


def word_features(word: str, before: str, follows: bool) -> list[int]:
    """Indices of the features that hold: shape of the word and the word before it."""
    digits = _NOT_DIGIT.sub("", word)
    size = next((i for i, n in enumerate(_SIZES) if len(digits) <= n), len(_SIZES))
    dots = word.count(".")
    tests = [
        True, "@" in word, "@" in word.strip("@") and "." in word.partition("@")[2].strip("."), word.startswith("+"),
        word.startswith("("), dots >= 3, dots >= 3 and bool(_IP.search(word)), "-" in word, ":" in word or "/" in word or "=" in word,
        any(c.isalpha() for c in word), len(digits) >= 13 and luhn(digits), digits == word.strip(".,;:()"), follows,
        word[:1].isdigit(), 2 * len(digits) >= len(word)]
    return [i for i, t in enumerate(tests) if t] + [len(tests) + size] + [_FIXED + crc32(before.lower().encode()) % _HASHED]


def similar_keys(word: str) -> list[str]:
    """Words with a key in common are joined by a skip edge."""
    digits = _NOT_DIGIT.sub("", word)
    keys = [f"w{word.strip('.,;:()[]<>').lower()}"]
    if len(digits) >= 7:
        keys += [f"d{digits}", f"t{digits[-7:]}"]
    if "@" in word:
        keys.append(f"l{word.partition('@')[0].strip('<([').lower()}")
    return keys


def add_document(graph: Graph, number: int, text: str, spans: list[Span]) -> None:
    """Add a document's words; labels come from its base spans."""
    last_end, last, seen = -2, -1, {}
    kinds = sorted((s, e, LABELS.index(k)) for k, s, e in spans)
    for m in _WORD.finditer(text):
        begin, end = m.span()
        near = text[max(0, begin - 40):begin].split()
        follows = last >= 0 and text[last_end:begin] == " "
        node = len(graph.spot)
        graph.spot.append((number, begin, end))
        graph.features.append(word_features(m.group(), near[-1] if near else "", follows))
        while kinds and kinds[0][1] <= begin and all(k[1] <= begin for k in kinds[:1]):
            kinds.pop(0)
        graph.label.append(next((k for s, e, k in kinds[:8] if s < end and e > begin), 0))
        if follows:
            graph.chain.append((last, node))
        linked = set()
        for key in similar_keys(m.group()):
            if key in seen and seen[key] not in linked:
                linked.add(seen[key])
                graph.skip.append((seen[key], node))
            seen[key] = node
        last, last_end = node, end


@dataclass
class Model:
    """Node weights (feature x label) and the two edge potentials (label x label), as logarithms."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _pair_potential(pairs: np.ndarray) -> np.ndarray:
    """Log ratio of joint to independent label frequencies over an edge, smoothed and symmetric."""
    size = len(LABELS)
    joint = np.full((size, size), 0.05) + np.eye(size)
    np.add.at(joint, (pairs[:, 0], pairs[:, 1]), 1.0)
    joint = joint + joint.T
    joint /= joint.sum()
    side = joint.sum(1)
    return np.clip(np.log(joint / np.outer(side, side)), -3.0, 3.0)


def fit(features: list[list[int]], label: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 200, rate: float = 2.0) -> Model | None:
    """Piecewise fit; None when the sample has no labelled word."""
    if not len(label) or not label.any():
        return None
    x = np.zeros((len(features), WIDTH), np.float32)
    for i, row in enumerate(features):
        x[i, row] = 1.0
    y = np.eye(len(LABELS), dtype=np.float32)[label]
    weights = np.zeros((WIDTH, len(LABELS)), np.float32)
    for _ in range(rounds):
        score = x @ weights
        guess = np.exp(score - score.max(1, keepdims=True))
        guess /= guess.sum(1, keepdims=True)
        weights -= rate * (x.T @ (guess - y) / len(y) + 1e-4 * weights)
    return Model(weights, _pair_potential(chain), _pair_potential(skip))


def fit_model(docs: DataFrame, text: str = "text", fit_words: int = FIT_WORDS) -> Model | None:
    """Fit on at most ``fit_words`` words of documents that have a figure 0-9 or an at sign, drawn from the whole table.

    The words of kinds that the sample lacks are counted over all rows, and drawn at the rate that takes half of the bound.
    """
    each = max(fit_words // _EACH, 1)

    def words(text: str, spans: list[Span]) -> list[tuple]:
        graph = Graph()
        add_document(graph, 0, text, spans)
        before, alike = [-1] * len(graph.spot), [-1] * len(graph.spot)
        for a, b in graph.chain:
            before[b] = graph.label[a]
        for a, b in graph.skip:
            alike[b] = graph.label[a]
        return list(zip(graph.features, graph.label, before, alike, strict=True))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        x, *rest = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), *[pa.array(c, pa.int32()) for c in rest]], ["x", "y", "c", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(0):
                found = words(value.as_py(), base_spans(value.as_py()))
                rows += [found[i] for i in even(len(found), each)]
            yield batch_of(rows)

    schema = "x array<int>, y int, c int, s int"
    some = docs.filter(F.col(text).rlike("[0-9@]"))
    total = some.agg(F.sum(F.least(F.regexp_count(text, F.lit(r"[0-9@]\S*")), F.lit(each)))).first()[0] or 0
    rows = share(some, 0.9 * fit_words / max(total, 1) if total > fit_words else 1.0).select(text).mapInArrow(run, schema).collect()
    rows = [rows[i] for i in even(len(rows), fit_words)]
    lacking = set(range(1, len(LABELS))) - {r["y"] for r in rows}

    def lacking_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for value in batch.column(0):
                spans = base_spans(value.as_py())
                if any(LABELS.index(kind) in lacking for kind, _, _ in spans):
                    yield from (row for row in words(value.as_py(), spans) if row[1] in lacking)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter(row[1] for row in lacking_words(batches))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["y", "n"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = np.random.default_rng(TaskContext.get().partitionId())  # a repeated task draws the same
        yield batch_of([row for row in lacking_words(batches) if chance.random() < rate.get(row[1], 0.0)])

    if lacking and total > fit_words:
        own = some.select(text)
        sums = own.mapInArrow(tally, "y int, n bigint").groupBy("y").agg(F.sum("n").alias("n")).collect()  # one row per kind
        rate = {r["y"]: fit_words / 2 / len(sums) / r["n"] for r in sums}
        more = own.mapInArrow(draw, schema).collect() if rate else []
        more = [more[i] for i in even(len(more), fit_words // 2)]
        rows = [rows[i] for i in even(len(rows), fit_words - len(more))] + more
    label = np.array([r["y"] for r in rows], int)
    pairs = [np.array([(r[c], r["y"]) for r in rows if r[c] >= 0], int).reshape(-1, 2) for c in ("c", "s")]
    return fit([r["x"] for r in rows], label, *pairs)


def posterior(graph: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by damped loopy message passing."""
    unary = np.array([model.node[row].sum(0) for row in graph.features], np.float64).reshape(-1, len(LABELS))
    pairs = np.array(graph.chain + graph.skip, int).reshape(-1, 2)
    tables = np.concatenate([np.repeat(model.chain[None], len(graph.chain), 0), np.repeat(model.skip[None], len(graph.skip), 0)])
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.zeros((len(source), len(LABELS)))

    def belief() -> np.ndarray:
        total = unary.copy()
        np.add.at(total, target, message)
        return total

    for _ in range(rounds if len(source) else 0):
        out = (belief()[source] - message[back])[:, :, None] + tables
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = belief()
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


_EDGE = ".,;:!?()[]<>{}\"'"


def _trimmed(text: str, begin: int, end: int, kind: str) -> tuple[int, int]:
    while begin < end and text[begin] in _EDGE and not (kind == "phone" and text[begin] == "("):
        begin += 1
    while end > begin and text[end - 1] in _EDGE:
        end -= 1
    return begin, end


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s, e) for _, s, e in spans):
        if out and begin < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _free(taken: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a stretch meets none of the sorted, disjoint ``taken``."""
    i = bisect_left(taken, (end,))
    return i == 0 or taken[i - 1][1] <= begin


def added_spans(graph: Graph, chance: np.ndarray, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans the field adds to each document: sure, plausible, and clear of the base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    taken = [_merged(spans) for spans in base]
    best = chance.argmax(1)
    sure = (best > 0) & (chance.max(1) >= SURE)
    linked = {b for _, b in graph.chain}
    i = 0
    while i < len(best):
        if not sure[i]:
            i += 1
            continue
        stop = i + 1
        while stop < len(best) and stop in linked and sure[stop] and best[stop] == best[i]:
            stop += 1
        number, kind = graph.spot[i][0], LABELS[best[i]]
        text = texts[number]
        whole = [(graph.spot[i][1], graph.spot[stop - 1][2])]
        for begin, end in whole + ([graph.spot[n][1:] for n in range(i, stop)] if stop > i + 1 else []):
            begin, end = _trimmed(text, begin, end, kind)
            if begin < end and plausible(kind, text[begin:end]) and _free(taken[number], begin, end):
                out[number].append((kind, begin, end))
                insort(taken[number], (begin, end))
        i = stop
    return out


def find(texts: list[str], model: Model | None) -> list[list[Span]]:
    """All spans of each text by kind, then start."""
    base = [base_spans(t) if _ANY.search(t) else [] for t in texts]
    if model is not None:
        graph = Graph()
        for i, t in enumerate(texts):
            if _ANY.search(t):
                add_document(graph, i, t, base[i])
        if graph.spot:
            extra = added_spans(graph, posterior(graph, model), texts, base)
            base = [a + b for a, b in zip(base, extra, strict=True)]
    return [sorted(spans, key=lambda s: (_RANK[s[0]], s[1], s[2])) for spans in base]


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def cleaned(text: str, spans: list[Span]) -> str:
    """The masked text; what a mask leaves standing alone (digits beside a masked address, say) is matched again."""
    while spans:
        text = masked(text, spans)
        spans = base_spans(text)
    return text


def _over(docs: DataFrame, text: str, schema: T.StructType, model: Model | None, finish: Callable) -> DataFrame:
    index = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                texts = [value.as_py() or "" for value in part.column(index)]
                yield finish(part, texts, find(texts, model))

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, text: str = "text", out: str = "spans", model: Model | None = None) -> DataFrame:
    """``docs`` with the personal data of each text; ``out`` replaces a column of the same name."""
    added = Added(docs, [T.StructField(out, SPANS)])

    def finish(part: pa.RecordBatch, texts: list[str], found: list[list[Span]]) -> pa.RecordBatch:
        return added.batch(part, [span_array(found)])

    return _over(docs, text, added.schema, model or fit_model(docs, text), finish)


def mask(docs: DataFrame, text: str = "text", size: str | None = None, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``size`` set to the new length of changed texts."""
    index = docs.columns.index(text)
    sized = docs.columns.index(size) if size in docs.columns else None

    def finish(part: pa.RecordBatch, texts: list[str], found: list[list[Span]]) -> pa.RecordBatch:
        if not any(found):
            return part
        old, columns = part.column(index).to_pylist(), list(part.columns)
        new = [cleaned(t, spans) if spans else o for o, t, spans in zip(old, texts, found, strict=True)]
        columns[index] = pa.array(new, part.schema.field(index).type)
        if sized is not None:
            before = part.column(sized).to_pylist()
            columns[sized] = pa.array([len(n) if s else b for n, s, b in zip(new, found, before, strict=True)], part.schema.field(sized).type)
        return pa.RecordBatch.from_arrays(columns, part.schema.names)

    return _over(docs, text, docs.schema, model or fit_model(docs, text), finish)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of base matches, their digest, and all spans."""

    def finish(part: pa.RecordBatch, texts: list[str], found: list[list[Span]]) -> pa.RecordBatch:
        # The contract counts and digests the pattern matches alone, so they are returned beside all spans.
        base = [base_spans(t) if spans else [] for t, spans in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), span_array(base), span_array(found)], [key, "base", "found"])

    own = docs.select(key, text)
    schema = T.StructType([own.schema.fields[0], T.StructField("base", SPANS), T.StructField("found", SPANS)])
    found = _over(own, text, schema, fit_model(own, text), finish)
    return found.select(
        key, *[count("base", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
