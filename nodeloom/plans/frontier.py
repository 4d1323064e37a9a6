"""Least values spread along edges: only changed rows are sent and only changed rows are written.

The state is a table in parts (:class:`nodeloom.plans.store.Parts`). A round sends the values of the
frontier, keeps those that improve on the state and appends them as the next part; a key's value is
the least over the parts and is merged when it is read. Once the state is large, the round's messages
are written first: when they are few next to it, their keys are broadcast and the state is filtered where
it lies, so a small frontier never shuffles a large state.

With a bucket width, values are settled bucket by bucket: rows beyond the bucket's end wait, edges
no longer than the width are relaxed until the bucket is quiet, longer ones once from its settled
rows (their targets lie beyond the bucket). A node is then sent few times, however unequal the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.skew import SpreadTable
from nodeloom.plans.store import Parts, save

#: Up to so many rows the state is looked up as a whole, in the job that sends.
WHOLE_ROWS = 2_000_000
#: Messages are few when the state has this many times their rows.
FEW = 8


@dataclass
class Search:
    """One search, which drops its edge table at the end: ``start`` is (*group, node_id, val), ``message()`` an expression over ``val`` and edge columns.

    ``weight`` names the edge column that buckets compare with their width.
    """

    edges: SpreadTable
    start: DataFrame
    message: Callable[[], Column]
    group: list[str] = field(default_factory=list)
    width: float | None = None
    weight: str = "_w"
    max_rounds: int | None = None
    rounds: int = 0

    def __post_init__(self) -> None:
        self.keys = [*self.group, "node_id"]
        self.state = Parts(self.start.groupBy(*self.keys).agg(F.min("val").alias("val")), "state")

    def run(self) -> DataFrame:
        """(*group, node_id, val) with the least value of every node that is reached."""
        first = self.state.add(self.state.blank, least=F.min("val"))
        if self.width is None:
            frontier, left = self.state.newest, first["n"]
            while left and (self.max_rounds is None or self.rounds < self.max_rounds):
                left = self._relax(frontier, self.edges)["n"]
                frontier = self.state.newest
        else:
            for low, end in self._buckets(first["least"]):
                self._settle(low, end)
        self.edges.drop()
        found = self.state.df
        return found.groupBy(*self.keys).agg(F.min("val").alias("val")) if self._may_fall() else found

    def _may_fall(self) -> bool:
        """A value may be written and fall later, unless every edge adds the same."""
        return self.weight in self.edges.saved.df.columns

    def _buckets(self, least: object) -> Iterator[tuple[object, object]]:
        while least is not None:
            yield least, least + self.width
            least = self.state.df.filter(F.col("val") >= least + self.width).agg(F.min("val")).first()[0]

    def _settle(self, low: object, end: object) -> None:
        inside = F.col("val") < end
        short, long = F.col(self.weight) <= self.width, F.col(self.weight) > self.width
        frontier, left = self._current(low, end), 1
        while left:
            left = self._relax(frontier, self._edges(short), inside=F.count_if(inside))["inside"]
            frontier = self.state.newest.filter(inside)
        if self._has(long):
            self._relax(self._current(low, end), self._edges(long))

    def _edges(self, which: Column) -> SpreadTable:
        return replace(self.edges, saved=replace(self.edges.saved, df=self.edges.saved.df.filter(which)))

    def _has(self, which: Column) -> bool:
        if not hasattr(self, "_long"):
            self._long = bool(self.edges.saved.df.filter(which).take(1))
        return self._long

    def _current(self, low: object, end: object) -> DataFrame:
        """Least values in a bucket of nodes that no earlier bucket settled."""
        rows = self.state.df
        here = rows.filter((F.col("val") >= low) & (F.col("val") < end)).groupBy(*self.keys).agg(F.min("val").alias("val"))
        done = rows.filter(F.col("val") < low).join(here.select(*self.keys), self.keys, "left_semi")
        return here.join(done, self.keys, "left_anti")

    def _relax(self, frontier: DataFrame, edges: SpreadTable, **measures: Column) -> dict:
        self.rounds += 1
        sent = edges.join(frontier.withColumnRenamed("node_id", "src"))
        sent = sent.select(*self.group, F.col("dst").alias("node_id"), self.message().alias("val"))
        sent = sent.groupBy(*self.keys).agg(F.min("val").alias("val"))
        if self.state.rows <= WHOLE_ROWS:
            return self.state.add(self._better(sent, self.state.df), **measures)
        held = save(sent, "sent")
        state = self.state.df
        if held.rows * FEW < self.state.rows:
            state = state.join(held.df.select(*self.keys), self.keys, "left_semi")
        seen = self.state.add(self._better(held.df, state), **measures)
        held.drop()
        return seen

    def _better(self, sent: DataFrame, state: DataFrame) -> DataFrame:
        """Messages below every value that their key has; a key may have several."""
        s, t = sent.alias("s"), state.alias("t")
        same = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in self.keys]
        beaten = reduce(and_, [*same, F.col("t.val") <= F.col("s.val")])
        return s.join(t, beaten, "left_anti").select(*self.keys, "val")
