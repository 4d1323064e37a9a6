"""Typed spans of text: the task that finds them and the digests made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.columns import Added

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

Span = tuple[str, int, int]
#: Rows of one output batch.
ROWS = 1000


def span_array(found: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in found], _ARROW)


def with_spans(docs: DataFrame, text: str, out: str, detector: Callable[[], Callable[[str], list[Span]]]) -> DataFrame:
    """``docs`` with the spans of each text; ``detector`` is made once per task, null text is empty.

    Positions count code points, the end is exclusive. ``out`` replaces a column of the same name.
    """
    index = docs.columns.index(text)
    added = Added(docs, [T.StructField(out, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = detector()
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                found = [detect(value.as_py() or "") for value in part.column(index)]
                yield added.batch(part, [span_array(found)])

    return docs.mapInArrow(run, added.schema)


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
