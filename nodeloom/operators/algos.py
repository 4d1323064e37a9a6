"""Iterative graph algorithms as rounds of joins and partial aggregations.

The edge table is written once, hot sources cut into shares, and every round joins it with
a small changed set or a node table; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.components import components
from nodeloom.plans.frontier import Search
from nodeloom.plans.skew import SpreadTable, spread
from nodeloom.plans.store import Saved, materialize, save


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node_id, dist): hop distance from every root; unreached nodes are absent."""
    start = roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).cast("bigint").alias("val"))
    table = spread(edges.select("src", "dst"), "src")
    found = Search(table, start, lambda: F.col("val") + 1, group=["root"], max_rounds=max_depth).run()
    return found.withColumnRenamed("val", "dist")


def sssp(edges_w: DataFrame, roots: DataFrame, weight: str = "w", width: float | None = None) -> DataFrame:
    """(root, node_id, dist): least path weight; works for integer and float weights >= 0.

    ``width`` is the bucket width of :class:`nodeloom.plans.frontier.Search`; without one, every value that fell
    is sent at once.
    """
    kind = edges_w.schema[weight].dataType
    start = roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).cast(kind).alias("val"))
    table = spread(edges_w.select("src", "dst", F.col(weight).alias("_w")), "src")
    found = Search(table, start, lambda: F.col("val") + F.col("_w"), group=["root"], width=width).run()
    return found.withColumnRenamed("val", "dist")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, comp): the least node id of the undirected component.

    Found by contraction (:mod:`nodeloom.plans.components`): no join has a label as its key,
    so a giant component never meets in one task.
    """
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ids = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("node_id"))
    found = components(pairs).df.withColumnRenamed("node", "node_id")
    return ids.distinct().join(found, "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("comp"))


def pagerank(
    edges: DataFrame, nodes: DataFrame, damp: float = 0.85, k: int = 20, *,
    norm: str = "in", simple: bool = False, write_every: int = 5,
) -> DataFrame:
    """(node_id, score) after ``k`` rounds.

    ``norm='in'`` divides a node's value by its own in-degree (at least 1) before it is sent,
    ``'out'`` by its out-degree (the textbook form). ``simple`` drops parallel edges. The
    degree rides along in the state, so a round is one join and one partial aggregation.
    """
    if simple:
        edges = edges.select("src", "dst").distinct()
    table = spread(edges.select("src", "dst"), "src")
    base = table.saved.df
    end = "dst" if norm == "in" else "src"
    ends = base.select(F.col(end).alias("node_id"), F.lit(1).cast("bigint").alias("d"))
    zero = nodes.select("node_id", F.lit(0).cast("bigint").alias("d"))
    deg = save(ends.unionByName(zero).groupBy("node_id").agg(F.greatest(F.sum("d"), F.lit(1)).alias("deg")), "deg")
    return _rank_rounds(table, deg, damp, k, write_every)


def _rank_rounds(table: SpreadTable, deg: Saved, damp: float, k: int, write_every: int) -> DataFrame:
    n = deg.rows
    # Zero rows keep nodes without in-edges and carry the degree; the previous state appears
    # once per round, so unwritten rounds stay a chain.
    base = deg.df.select("node_id", F.lit(0.0).alias("x"), "deg")
    state = deg.df.select("node_id", "deg", F.lit(1.0 / max(n, 1)).alias("score"))
    for i in range(k):
        sent = table.join(state.select(F.col("node_id").alias("src"), (F.col("score") / F.col("deg")).alias("x")))
        rows = sent.select(F.col("dst").alias("node_id"), "x", F.lit(None).cast("bigint").alias("deg")).unionByName(base)
        state = rows.groupBy("node_id").agg(F.max("deg").alias("deg"), F.sum("x").alias("x")).select(
            "node_id", "deg", (F.lit((1 - damp) / max(n, 1)) + F.lit(damp) * F.col("x")).alias("score")
        )
        if (i + 1) % write_every == 0:
            state = materialize(state, "rank")
    return state.select("node_id", "score")


def pagerank_hetero(typed_edges: DataFrame, nodes: DataFrame, damp: float = 0.85, k: int = 20,
                    write_every: int = 5) -> DataFrame:
    """(ntype, node_id, score) over all types: N counts every node, contributions add up across
    edge types, and a node's value is divided by its total out-degree over edge types.

    Typed ids become one struct-free key (:func:`_typed_keys`) for the shared rounds.
    """
    key, names = _typed_keys(typed_edges, nodes)
    flat = typed_edges.select(key("src_type", "src").alias("src"), key("dst_type", "dst").alias("dst"))
    table = spread(flat, "src")
    ends = table.saved.df.select(F.col("src").alias("node_id"), F.lit(1).cast("bigint").alias("d"))
    zero = nodes.select(key("ntype", "node_id").alias("node_id"), F.lit(0).cast("bigint").alias("d"))
    deg = save(ends.unionByName(zero).groupBy("node_id").agg(F.greatest(F.sum("d"), F.lit(1)).alias("deg")), "deg")
    out = _rank_rounds(table, deg, damp, k, write_every)
    return out.select(*names(F.col("node_id")), "score")


def _typed_keys(typed_edges: DataFrame, nodes: DataFrame) -> tuple[Callable[[str, str], Column], Callable[[Column], list[Column]]]:
    """How a type and an id become one key, and a key (ntype, node_id) again.

    The key is the id with the type's number in its lowest bits, half as long in every exchange as a text. Ids that
    leave no bits free, and missing ones, take the type and the id as text.
    """
    end = lambda t, i: F.struct(F.col(t).alias("t"), F.col(i).alias("i"))
    ends = typed_edges.select(F.explode(F.array(end("src_type", "src"), end("dst_type", "dst"))).alias("x")).select("x.*")
    ends = ends.unionByName(nodes.select(F.col("ntype").alias("t"), F.col("node_id").alias("i")))
    found = ends.groupBy("t").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_if(F.col("i").isNull()).alias("missing"))
    rows = sorted(found.collect(), key=lambda r: r["t"] or "")  # one row per node type
    bits = max(len(rows) - 1, 1).bit_length()
    room = 1 << (63 - bits)
    if any(r["t"] is None or r["missing"] or r["lo"] < -room or r["hi"] >= room for r in rows):
        part = lambda key: F.split(key, ":")
        return (lambda t, i: F.concat_ws(":", F.col(t), F.col(i).cast("string")),
                lambda key: [part(key)[0].alias("ntype"), part(key)[1].cast("bigint").alias("node_id")])
    types = [r["t"] for r in rows]

    def key_of(t: str, i: str) -> Column:
        code = F.lit(None).cast("bigint")
        for n, name in enumerate(types):
            code = F.when(F.col(t) == name, F.lit(n).cast("bigint")).otherwise(code)
        return F.shiftleft(F.col(i).cast("bigint"), bits).bitwiseOR(code)

    def names(key: Column) -> list[Column]:
        number = key.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")
        listed = F.array(*[F.lit(name) for name in types]) if types else F.array().cast("array<string>")
        return [F.get(listed, number).alias("ntype"), F.shiftright(key, bits).alias("node_id")]

    return key_of, names
