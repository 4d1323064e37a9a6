"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into text blocks at block-level tags. A linear classifier on text features (length,
links, punctuation), fitted on a bounded sample whose weak labels come from structural tags, and
the block's structural evidence (enclosing tags, class and id words) together give each block
a cost of being boilerplate or of being content. These are its terminal capacities. Blocks that
follow one another and blocks with the same parent are joined by smoothness edges; the minimum
cut separates content from boilerplate, and the content blocks are joined in page order.

Defined results: null or empty html gives empty text; a tag that the page's end cuts off is
dropped; unclosed elements are closed as a browser would where it matters here (``p``, ``li``,
cells); comments, scripts and styles are never text. Whole pages are read, row by row.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.samples import even, spread

#: Sampled blocks the text classifier is fitted on.
FIT_BLOCKS = 20_000
#: Blocks that one sampled page gives at most, and that a page has about.
_PAGE_BLOCKS, _USUAL_BLOCKS = 100, 10
NEAR, SIBLING = 0.6, 0.8
_CERTAIN = 50.0
#: Costs of an element whose name ends in, or only has, a word of a page part; and of a form with little text for its controls.
_NAMED, _PARTLY, _FORM = -5.0, -2.5, -5.0
#: Words of text a visible control, from which a form is taken for a wrapper; share of a page's text that makes any element one.
_FORM_WORDS, _MOST = 25, 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_UNSEEN = re.compile(r"""type\s*=\s*["']?hidden|\shidden(?=[\s=]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML element groups and the class words that name page parts.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_BOILERPLATE_TAGS = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head", "object", "audio", "video", "canvas"}
_BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "dialog", "alert", "menu", "menubar"}
_FORMS, _FORM_ROLES, _CONTROLS = {"form", "fieldset"}, {"search", "form"}, {"input", "select", "textarea", "button"}
#: Before a word, they say what the page has beside the element's text.
_MODIFIERS = {"has", "with", "without", "no", "is", "show", "hide"}
_BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "share", "sharing", "social", "related", "recommended", "recommendations", "sidebar", "widget", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "comment", "comments", "respond", "replies",
    "disqus", "toolbar", "search", "skip", "copyright", "disclaimer", "teaser", "tags", "toc"}
_CONTENT_WORDS = {"article", "content", "story", "post", "entry", "main", "body", "text"}
_LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt"}
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul", "details", "figure"}


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    links: int
    structure: float
    parent: int
    tag: str


@dataclass
class _Open:
    tag: str
    number: int
    evidence: float
    inside: bool
    #: The nearest enclosing elements that are judged once the page is read: of all, and of those around the last article; 0 for none.
    soft: int = 0
    outer: int = 0


@dataclass
class _Soft:
    """An element that may be a page part or a wrapper of the text: its cost, text outside links, words and visible controls."""

    cost: float
    form: bool
    above: int
    outer: int
    size: int = 0
    words: int = 0
    controls: int = 0


def _name_cost(names: str) -> float:
    """Cost of an element by its class and id: the last word of a name says what it is, others less; 0 for none."""
    cost = 0.0
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in _MODIFIERS:
            hit = [w in _BOILERPLATE_WORDS for w in words]
            cost = min(cost, _NAMED if hit[-1] else _PARTLY if any(hit) else 0.0)
    return cost


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(source)}


def _evidence(tag: str, source: str, above: _Open) -> tuple[float, bool, float]:
    """Structural evidence of an element's text (positive: content), whether it lies in an article, and the element's own cost."""
    value, inside, cost = above.evidence, above.inside, 0.0
    if tag in ("article", "main"):
        value, inside = max(value, 0.0) + 4.0 if value > -_CERTAIN else value, True
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not inside):
        return -_CERTAIN, inside, 0.0
    if source:
        found = _attributes(source)
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
            return -_CERTAIN, inside, 0.0
        role = found.get("role", "").lower()
        if role in _BOILERPLATE_ROLES:
            return -_CERTAIN, inside, 0.0
        names = found.get("class", "") + " " + found.get("id", "")
        words = {w.lower() for w in _WORD.findall(names)}
        if tag not in ("html", "body"):
            if not (words & {"article", "content", "main"} and tag in ("article", "main")):
                cost = _name_cost(names)
            if role in _FORM_ROLES or ("header" in words and not inside):
                cost = min(cost, _NAMED)
            if words & _CONTENT_WORDS:
                value = value + 1.0 if value > -_CERTAIN else value
    return value, inside, cost


def _judge(found: list[tuple[Block, _Open]], soft: dict[int, _Soft]) -> None:
    """Charge each block for the page parts around it.

    A form with much text for its controls is a wrapper. So is, where no article stands free of
    page parts, an article's surroundings, and without any article an element with most of the text.
    """
    if not soft:
        return
    open_text = [(b, o) for b, o in found if o.evidence > -_CERTAIN]
    total = 0
    for block, top in open_text:
        size = len(block.text) - min(block.links, len(block.text))
        total += size
        if top.soft:
            soft[top.soft].size += size
            soft[top.soft].words += block.text.count(" ") + 1
    for own in reversed(soft.values()):  # inner elements come after outer ones
        if own.above:
            above = soft[own.above]
            above.size, above.words, above.controls = above.size + own.size, above.words + own.words, above.controls + own.controls
    inside = any(o.inside for _, o in open_text)
    every, near = {0: 0.0}, {}  # least cost on the way out, of all elements and up to the last article
    for number, own in soft.items():
        cost = min(own.cost, _FORM if own.form and own.controls and own.words < _FORM_WORDS * own.controls else 0.0)
        cost = cost if inside or own.size <= _MOST * total else 0.0
        every[number] = min(cost, every[own.above])
        near[number] = cost if own.above == own.outer else min(cost, near[own.above])
    free = any(o.inside and not every[o.soft] for _, o in open_text)
    for block, top in open_text:
        cost = every[top.soft] if free else 0.0 if top.soft == top.outer else near[top.soft]
        if cost < 0:
            block.structure = min(block.structure, 0.0) + cost


def blocks_of(page: str) -> list[Block]:
    """The non-empty text blocks of a page in order."""
    out: list[tuple[Block, _Open]] = []
    soft: dict[int, _Soft] = {}
    stack = [_Open("", 0, 0.0, False)]
    parts: list[str] = []
    numbers, links, at, end = 1, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                i = len(stack) - 1
                while stack[i].tag in _INLINE:
                    i -= 1
                top = stack[i]
                holder = stack[max(i - 1, 0)] if top.tag in _LEAVES else top
                out.append((Block(text, links, stack[-1].evidence, holder.number, top.tag), stack[-1]))
            parts.clear()
        links = 0

    def close(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while at < end:
        found = _TAG.search(page, at)
        piece = page[at:found.start() if found else end]
        if piece:
            parts.append(piece)
            if any(o.tag == "a" for o in stack[-4:]):
                links += len(piece)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in _CONTROLS and not closing and not _UNSEEN.search(found[3]):
            if stack[-1].soft:
                soft[stack[-1].soft].controls += 1
        if tag in _RAW and not closing:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if closing:
            close({tag}, set() if tag not in _INLINE else {"p", "div", "td", "li", "article", "body"})
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"button", "td", "th", "div", "article", "section", "li", "body"})
        if tag in _CLOSES:
            close(_CLOSES[tag], {"ul", "ol", "table", "dl", "div", "article", "section", "body", "select"} - _CLOSES[tag])
        if tag in _VOID or found.group().endswith("/>") and tag in ("img", "path"):
            continue
        above = stack[-1]
        value, inside, cost = _evidence(tag, found[3], above)
        own, outer = above.soft, above.outer
        if tag in ("article", "main"):
            outer = own
        if cost or tag in _FORMS:
            soft[numbers] = _Soft(cost, tag in _FORMS, own, outer)
            own = numbers
        stack.append(_Open(tag, numbers, value, inside, own, outer))
        numbers += 1
    flush()
    _judge(out, soft)
    return [block for block, _ in out]


FEATURES = 6


def features(block: Block) -> list[float]:
    """Text features: size, links, sentence marks, word length, digits and a constant."""
    size, words = len(block.text), block.text.count(" ") + 1
    marks = sum(map(block.text.count, ".,;:!?"))
    digits = sum(map(block.text.count, "0123456789"))
    return [1.0, log1p(words), min(block.links / size, 1.0), min(marks / words, 1.0), min(size / words / 10, 2.0), min(digits / size, 1.0)]


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient descent; both classes weigh the same."""
    if not len(rows) or labels.min() == labels.max():
        return np.array([-2.0, 1.0, -4.0, 1.0, 0.0, 0.0])
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))[:, None]
    model = np.zeros(rows.shape[1])
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-rows @ model))
        model -= rate * ((weight * rows * (guess - labels)[:, None]).mean(0) + decay * model)
    return model


def fit_model(pages: DataFrame, page: str = "html", fit_blocks: int = FIT_BLOCKS) -> list[float]:
    """Weights of the text features from at most ``fit_blocks`` blocks with clear structural evidence, from pages of the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                found = [(features(b), float(b.structure > 0)) for b in blocks_of(value.as_py() or "") if b.structure]
                found = [found[i] for i in even(len(found), _PAGE_BLOCKS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.float64())], ["x", "y"])

    sample = spread(pages, max(fit_blocks // _USUAL_BLOCKS, 1)).select(page).mapInArrow(run, "x array<double>, y double").collect()
    sample = [sample[i] for i in even(len(sample), fit_blocks)]
    return fit(np.array([r["x"] for r in sample]).reshape(-1, FEATURES), np.array([r["y"] for r in sample])).tolist()


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the capacity cut: ``gain[i] > 0`` pulls node i to the source side.

    A node's two terminal capacities are reduced to their difference. Flow is then pushed from
    nodes with a surplus to nodes with a deficit along shortest residual paths; nodes that
    a remaining surplus can reach are on the source side.
    """
    size = len(gain)
    near: list[list[int]] = [[] for _ in range(size)]
    to, room = [], []
    for a, b, weight in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(weight)
        near[b].append(len(to))
        to.append(a)
        room.append(weight)
    left = list(gain)
    while True:
        came: dict[int, int] = {}
        seen = [g > 1e-9 for g in left]
        queue = deque(i for i in range(size) if seen[i])
        goal = -1
        while queue and goal < 0:
            i = queue.popleft()
            for e in near[i]:
                j = to[e]
                if room[e] > 1e-9 and not seen[j]:
                    seen[j], came[j] = True, e
                    if left[j] < -1e-9:
                        goal = j
                        break
                    queue.append(j)
        if goal < 0:
            return seen
        path, j = [], goal
        while j in came:
            path.append(came[j])
            j = to[came[j] ^ 1]
        flow = min(left[j], -left[goal], *(room[e] for e in path))
        left[j] -= flow
        left[goal] += flow
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def label(blocks: list[Block], model: list[float]) -> list[bool]:
    """True for content blocks."""
    gain, edges, last = [], [], {}
    for i, block in enumerate(blocks):
        text = sum(w * x for w, x in zip(model, features(block), strict=True))
        gain.append(max(-3.0, min(3.0, text)) + block.structure)
        if i:
            edges.append((i - 1, i, NEAR))
        if block.parent in last:
            edges.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    return minimum_cut(gain, edges)


def main_text(page: str | None, model: list[float]) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, content in zip(blocks, label(blocks, model), strict=True) if content)


def extract(pages: DataFrame, *, page: str = "html", out: str = "text", model: list[float] | None = None) -> DataFrame:
    """``pages`` without the html column but with the main text of each page, which replaces a column of that name."""
    weights = model or fit_model(pages, page)
    index = pages.columns.index(page)
    kept = [i for i, f in enumerate(pages.schema.fields) if f.name != page and f.name.lower() != out.lower()]
    schema = T.StructType([*(pages.schema.fields[i] for i in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(value.as_py(), weights) for value in batch.column(index)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), text], schema.names)

    return pages.mapInArrow(run, schema)


def report(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, main text and its length in code points."""
    return extract(pages.select(key, url, page), page=page, out="text").withColumn("n_chars", F.length("text").cast("bigint"))
