"""Messages and reducers that users write themselves, as numpy functions over Arrow batches.

A :class:`Fold` reduces through states of fixed width: values of a batch are reduced per destination at
once, states are exchanged, sorted by destination and merged as they stream by. A hub sends one state per
batch, and no task ever holds more than a batch and one open state. Reducers that need all values in
order, such as a median, go through :func:`quantile`, where a range sort cuts a hub over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.scan import global_rank
from nodeloom.plans.store import save

#: From arrays of the columns that were asked for to one value per edge.
Message = Callable[..., np.ndarray]


@dataclass
class Fold:
    """A reducer with states of ``width`` numbers.

    ``start(values)`` gives a (rows, width) state for every value alone, ``merge(a, b)`` joins two (rows, width) arrays of
    states row by row and must not depend on order or grouping, ``finish(states)`` gives one number per row.
    """

    width: int
    start: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]

    def reduce(self, states: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One state per group of consecutive rows: neighbours are merged in halving rounds."""
        group = np.zeros(len(states), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        while len(states) > len(starts):
            first = np.searchsorted(group, group)
            odd = (np.arange(len(group)) - first) % 2 == 1
            left = np.flatnonzero(odd) - 1
            states = states.copy()
            states[left] = self.merge(states[left], states[left + 1])
            states, group = states[~odd], group[~odd]
        return states


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _batch(keys: np.ndarray, states: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(0, states.size + 1, states.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(states.ravel(), pa.float64()))], ["node_id", "state"])


def update_all(edges: DataFrame, node_val: DataFrame, message: Message, reducer: Fold, columns: Sequence[str] = ("val",)) -> DataFrame:
    """(node_id, val): ``message`` of every edge, reduced per destination.

    ``message`` gets the arrays of ``columns``: columns of ``node_val`` (node_id, ...) for the source, and of
    ``edges`` (src, dst, ...). Rows whose message is not a number count like any other. An empty input gives no row.
    """
    joined = edges.join(node_val.withColumnRenamed("node_id", "src"), "src")
    rows = joined.select(F.col("dst").cast("bigint").alias("node_id"), *[F.col(c).cast("double").alias(c) for c in columns])
    width = reducer.width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.asarray(message(*[batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))]), np.float64)
            order = np.argsort(keys, kind="stable")
            keys, starts = keys[order], _runs(keys[order])
            yield _batch(keys[starts], reducer.reduce(np.asarray(reducer.start(values[order]), np.float64).reshape(-1, width), starts))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros((0, width))

        def out(keys: np.ndarray, states: np.ndarray) -> pa.RecordBatch:
            value = np.asarray(reducer.finish(states), np.float64) if len(keys) else np.zeros(0)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(value)], ["node_id", "val"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            states = np.concatenate([held, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)])
            starts = _runs(keys)
            keys, states = keys[starts], reducer.reduce(states, starts)
            yield out(keys[:-1], states[:-1])
            held_key, held = keys[-1:], states[-1:]
        yield out(held_key, held)

    states = rows.mapInArrow(partial, "node_id bigint, state array<double>")
    return states.repartition("node_id").sortWithinPartitions("node_id").mapInArrow(final, "node_id bigint, val double")


def quantile(edges: DataFrame, node_val: DataFrame, q: float = 0.5) -> DataFrame:
    """(node_id, val): the ``q`` quantile of the sources' values per destination, between two values in proportion.

    All messages are sorted by (destination, value, source) in one range sort, so a hub is cut like any other
    range; a destination's own places follow from its first place. Null values do not count.
    """
    sent = edges.join(node_val.select(F.col("node_id").alias("src"), "val"), "src").filter(F.col("val").isNotNull())
    ranked = save(global_rank(sent.select("dst", "val", "src"), [F.col("dst"), F.col("val"), F.col("src")], "_r"), "ranked").df
    spans = save(ranked.groupBy("dst").agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n")), "spans").df
    place = F.col("_first") + F.lit(float(q)) * (F.col("_n") - 1)
    picks = spans.select("dst", place.alias("_place"), F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_r"))
    part = F.lit(1.0) - F.abs(F.col("_r") - F.col("_place"))
    share = F.when(F.floor("_place") == F.ceil("_place"), F.lit(1.0)).otherwise(part)
    found = picks.join(ranked.select("_r", "val"), "_r")
    return found.groupBy(F.col("dst").alias("node_id")).agg(F.sum(share * F.col("val")).alias("val"))


#: Population variance from counts, means and squared distances.
VARIANCE = Fold(
    3,
    lambda v: np.stack([np.ones_like(v), v, np.zeros_like(v)], axis=1),
    lambda a, b: np.stack([a[:, 0] + b[:, 0], (a[:, 0] * a[:, 1] + b[:, 0] * b[:, 1]) / (a[:, 0] + b[:, 0]),
                           a[:, 2] + b[:, 2] + (b[:, 1] - a[:, 1]) ** 2 * a[:, 0] * b[:, 0] / (a[:, 0] + b[:, 0])], axis=1),
    lambda s: s[:, 2] / s[:, 0],
)
