"""Fill-in-the-middle rearrangement of texts by scattering bytes.

A text of n lines (a line ends after its newline) is cut at two line boundaries drawn from a
digest of its key. ``psm`` writes ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` writes
``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` leaves the text as it is: an empty text,
one that holds a marker itself, or one not drawn at ``rate``.

All texts of a slice are one byte array. The cuts give a difference array of displacements; its
running sum is how far each byte moves, one scatter writes all outputs of the slice. The way back
reads the markers of the outputs, derives the same displacements and gathers. Displacements are
made a block of bytes at a time, so a very long text costs its own bytes twice and no more.

Defined results: null and empty text give n = 0, form ``plain`` and an empty output; a null key is
drawn as an empty one; equal rows give equal outputs; a new column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import slices
from nodeloom.llm.columns import Added, free_name

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
FORMS = ["plain", "psm", "spm"]
PLAIN, PSM, SPM = range(3)

#: Bytes whose displacements are held at once.
BLOCK = 1 << 20


def find(data: np.ndarray, marker: bytes) -> np.ndarray:
    """Positions of a marker in ``data``."""
    if len(data) < MARK:
        return np.zeros(0, np.int64)
    hit = (data[:-2] == marker[0]) & (data[1:-1] == marker[1]) & (data[2:] == marker[2])
    return np.flatnonzero(hit)


def line_cuts(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text and the byte positions of its two cuts."""
    begin, end = bounds[:-1], bounds[1:]
    line_end = np.flatnonzero(data == 0x0A) + 1
    first = np.searchsorted(line_end, begin, "right")
    closed = np.searchsorted(line_end, end, "right") - first
    open_end = np.zeros(len(begin), bool)
    full = end > begin
    open_end[full] = data[end[full] - 1] != 0x0A
    lines = closed + open_end
    units = np.sort(draws[:, :2] % (lines + 1)[:, None], axis=1)
    places = np.concatenate([line_end, [len(data)]])
    at = []
    for unit in units.T:
        inner = places[np.minimum(first + np.maximum(unit, 1) - 1, len(line_end))]
        at.append(np.where(unit == 0, begin, np.where(unit > closed, end, inner)))
    return lines, at[0], at[1]


@dataclass
class Layout:
    """Where the three segments of each text lie, before and after the move."""

    begin: np.ndarray  # first byte of the text
    prefix: np.ndarray  # bytes of the segments
    middle: np.ndarray
    suffix: np.ndarray
    form: np.ndarray

    def __post_init__(self) -> None:
        size = self.prefix + self.middle + self.suffix
        self.bounds = np.concatenate([[0], np.cumsum(size + np.where(self.form == PLAIN, 0, 3 * MARK))])

    def markers(self) -> list[tuple[bytes, np.ndarray]]:
        """Output positions of each marker, of the texts that have markers."""
        out, p, s = self.bounds[:-1], self.prefix, self.suffix
        psm, spm = self.form == PSM, self.form == SPM
        at_prefix = np.concatenate([out[psm], (out + MARK + s)[spm]])
        at_suffix = np.concatenate([(out + MARK + p)[psm], out[spm]])
        at_middle = (out + 2 * MARK + p + s)[psm | spm]
        return [(PREFIX, at_prefix), (SUFFIX, at_suffix), (MIDDLE, at_middle)]

    def displacements(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, shift of every byte) in blocks over the texts' bytes."""
        out, p, m, s, form = self.bounds[:-1], self.prefix, self.middle, self.suffix, self.form
        to_prefix = out + np.choose(form, [0, MARK, 2 * MARK + s])
        to_suffix = out + np.choose(form, [p + m, 2 * MARK + p, MARK])
        to_middle = out + np.choose(form, [p, 3 * MARK + p + s, 3 * MARK + p + s])
        source = np.stack([self.begin, self.begin + p, self.begin + p + m], axis=1).ravel()
        target = np.stack([to_prefix, to_middle, to_suffix], axis=1).ravel()
        change = np.diff(target - source, prepend=0)
        size = int(np.sum(p + m + s))
        carry = 0
        for low in range(0, size, BLOCK):
            high = min(low + BLOCK, size)
            a, b = np.searchsorted(source, [low, high])
            step = np.zeros(high - low, np.int64)
            np.add.at(step, source[a:b] - low, change[a:b])
            step[0] += carry
            shift = np.cumsum(step)
            carry = shift[-1]
            yield low, high, shift


def scatter(data: np.ndarray, layout: Layout) -> np.ndarray:
    """The outputs of all texts as one byte array."""
    out = np.empty(int(layout.bounds[-1]), np.uint8)
    for low, high, shift in layout.displacements():
        out[np.arange(low, high) + shift] = data[low:high]
    for marker, at in layout.markers():
        for i in range(MARK):
            out[at + i] = marker[i]
    return out


def gather(out: np.ndarray, layout: Layout) -> np.ndarray:
    """The texts behind the outputs."""
    size = int(np.sum(layout.prefix + layout.middle + layout.suffix))
    data = np.empty(size, np.uint8)
    for low, high, shift in layout.displacements():
        data[low:high] = out[np.arange(low, high) + shift]
    return data


def rearranged(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray, rate: int, spm: int) -> tuple[np.ndarray, Layout, np.ndarray]:
    """Outputs, layout and lines of texts ``bounds`` of ``data``, cut by four draws each."""
    lines, one, two = line_cuts(data, bounds, draws)
    form = np.where(draws[:, 3] % 100 < spm, SPM, PSM)
    form[(draws[:, 2] % 100 >= rate) | (bounds[1:] == bounds[:-1])] = PLAIN
    for marker in (PREFIX, SUFFIX, MIDDLE):
        at = find(data, marker)
        text = np.searchsorted(bounds, at, "right") - 1
        form[text[at + MARK <= bounds[text + 1]]] = PLAIN
    layout = Layout(bounds[:-1], one - bounds[:-1], two - one, bounds[1:] - two, form)
    return scatter(data, layout), layout, lines


def read_layout(out: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> Layout:
    """The layout of outputs ``bounds`` of ``out``, from their markers."""
    begin, end = bounds[:-1], bounds[1:]
    at = []
    for marker in (PREFIX, SUFFIX, MIDDLE):
        places = np.concatenate([find(out, marker), [len(out)]])
        at.append(places[np.searchsorted(places, begin)])
    p, s, m = at
    moved = form != PLAIN
    ordered = np.where(form == PSM, (p == begin) & (p < s) & (s < m), (s == begin) & (s < p) & (p < m)) & (m + MARK <= end)
    if np.any(moved & ~ordered):
        raise ValueError("an output lacks the markers of its form")
    prefix = np.where(form == PSM, s - p, m - p) - MARK
    suffix = np.where(form == PSM, m - s, p - s) - MARK
    middle = end - m - MARK
    prefix[~moved], middle[~moved], suffix[~moved] = (end - begin)[~moved], 0, 0
    sizes = prefix + middle + suffix
    return Layout(np.cumsum(sizes) - sizes, prefix, middle, suffix, form)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def text_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(bounds.astype(np.int32))
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])


_HEX = np.zeros(256, np.int64)
_HEX[list(b"0123456789abcdef")] = np.arange(16)


def draws_of(column: pa.Array) -> np.ndarray:
    """The first four groups of eight hex digits of each digest, as integers."""
    digits, _ = text_bytes(column)
    groups = _HEX[digits.reshape(len(column), 64)[:, :32]].reshape(len(column), 4, 8)
    return groups @ (1 << np.arange(28, -1, -4, dtype=np.int64))


def characters(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code points in byte ranges of ``data``."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(heads, begin + size) - np.searchsorted(heads, begin)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", *, seed: int = 7, rate: int = 100, spm: int = 50,
              out: str = "output") -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and the rearranged text.

    Of 100 texts about ``rate`` are rearranged, of 100 of these about ``spm`` suffix first. The
    draws are the sha256 of ``seed:key``, so a repeated task decides the same.
    """
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
              T.StructField("middle_chars", T.LongType()), T.StructField(out, T.StringType())]
    added, index = Added(docs, fields), docs.columns.index(text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(index)):
                part = batch.slice(begin, end - begin)
                data, bounds = text_bytes(part.column(index))
                made, lay, lines = rearranged(data, bounds, draws_of(part.column(part.num_columns - 1)), rate, spm)
                plain = lay.form == PLAIN
                yield added.batch(part, [
                    pa.array(lines, pa.int64()),
                    pa.array(np.array(FORMS, object)[lay.form], pa.string()),
                    pa.array(characters(data, lay.begin, lay.prefix), pa.int64(), mask=plain),
                    pa.array(characters(data, lay.begin + lay.prefix, lay.middle), pa.int64(), mask=plain),
                    text_array(made, lay.bounds),
                ])

    return docs.withColumn(free_name(docs, "_digest"), digest).mapInArrow(run, added.schema)


def restore(docs: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """``docs`` with the exact text behind each output, from the output and its form alone."""
    added = Added(docs, [T.StructField(out, T.StringType())])
    at_output, at_form = docs.columns.index(output), docs.columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(at_output)):
                part = batch.slice(begin, end - begin)
                data, bounds = text_bytes(part.column(at_output))
                codes = pc.fill_null(pc.index_in(part.column(at_form), pa.array(FORMS)), PLAIN)
                lay = read_layout(data, bounds, codes.to_numpy(zero_copy_only=False).astype(np.int64))
                yield added.batch(part, [text_array(gather(data, lay), np.concatenate([lay.begin, [bounds[-1] - _added(lay)]]))])

    return docs.mapInArrow(run, added.schema)


def _added(layout: Layout) -> int:
    return 3 * MARK * int(np.count_nonzero(layout.form != PLAIN))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: key, n, form, the segments' code points and digests of the output and of the restored text."""
    made = transform(docs.select(key, text), key, text).select(key, "n", "form", "prefix_chars", "middle_chars", "output")
    back = restore(made)
    return back.select(key, "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
