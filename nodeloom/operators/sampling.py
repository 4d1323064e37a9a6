"""Seeded neighbourhood sampling.

Neighbour sampling never ranks whole neighbour lists. Edges are indexed once as
(dst, ord, src); a draw picks ordinals from the degree alone and fetches exactly those
rows, so a hub with a third of all edges costs no more per draw than any other node, and
its index rows are spread by (dst, ord).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.hashing import digest, hash_long, pick_ordinals, uniform
from nodeloom.plans.scan import grouped_rank, prefix_scan, top_k_per_group
from nodeloom.plans.store import bucket_count, materialize, save, save_bucketed


@dataclass
class EdgeIndex:
    """``rows`` is (dst, ord, src), ``degrees`` is (dst, deg); both written, for any number of draws."""

    rows: DataFrame
    degrees: DataFrame


def edge_index(edges: DataFrame) -> EdgeIndex:
    """Number each node's in-neighbours by id. A large index is bucketed by (dst, ord): a draw
    then shuffles the drawn ordinals only, and a hub fills no bucket."""
    degrees = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("deg"))
    ranked = grouped_rank(edges.select("src", "dst"), ["dst"], "src", "ord").select("dst", "ord", "src")
    degrees = materialize(degrees, "degrees")
    total = degrees.agg(F.sum("deg")).first()[0] or 0
    buckets = bucket_count(edges.sparkSession, total)
    saved = save_bucketed(ranked, "edge_index", ["dst", "ord"], buckets) if buckets else save(ranked, "edge_index")
    return EdgeIndex(saved.df, degrees)


def sample_layer(index: EdgeIndex, frontier: DataFrame, fanout: int, seed: int, epoch: int, layer: int,
                 tag: str = "") -> DataFrame:
    """(batch_id, src, dst): up to ``fanout`` uniform in-neighbours of every frontier node."""
    asked = frontier.select("batch_id", F.col("node_id").alias("dst")).join(index.degrees, "dst")
    ords = pick_ordinals(F.col("deg"), fanout, seed, epoch, layer, tag, F.col("batch_id"), F.col("dst"))
    draws = asked.select("batch_id", "dst", F.explode(ords).alias("ord"))
    return draws.join(index.rows, ["dst", "ord"]).select("batch_id", "src", "dst")


def _grow(frontier: DataFrame, block: DataFrame) -> DataFrame:
    return frontier.unionByName(block.select("batch_id", F.col("src").alias("node_id"))).distinct()


def sample_neighbors(
    edges: DataFrame, seeds: DataFrame, fanouts: Sequence[int], seed: int = 0, epoch: int = 0, *,
    index: EdgeIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Multi-layer sampling: (blocks, input nodes).

    ``seeds`` is (batch_id, node_id). The last fan-out applies to the seeds; the next frontier
    is the union of a layer's sources and destinations. Blocks are (batch_id, layer, src, dst),
    with layer 0 next to the input features. Pass ``index`` to reuse one over epochs.
    """
    index = edge_index(edges) if index is None else index
    frontier = materialize(seeds.select("batch_id", "node_id").distinct(), "frontier")
    blocks = []
    for layer in reversed(range(len(fanouts))):
        block = materialize(sample_layer(index, frontier, fanouts[layer], seed, epoch, layer), "block")
        frontier = materialize(_grow(frontier, block), "frontier")
        blocks.append(block.select("batch_id", F.lit(layer).cast("bigint").alias("layer"), "src", "dst"))
    return reduce(DataFrame.unionByName, reversed(blocks)), frontier


def khop_full(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(set_id, node_id): each seed with all nodes that reach it in at most ``hops`` steps."""
    frontier = reached = seeds.select("set_id", "node_id")
    for hop in range(hops):
        step = frontier.join(edges.select(F.col("dst").alias("node_id"), "src"), "node_id")
        grown = reached.unionByName(step.select("set_id", F.col("src").alias("node_id"))).distinct()
        if hop + 1 == hops:
            return grown
        grown = materialize(grown, "khop")
        frontier, reached = grown.join(reached, ["set_id", "node_id"], "left_anti"), grown
    return reached


def sample_neighbors_hetero(
    typed_edges: DataFrame, seeds: DataFrame, fanouts: Sequence[int], seed: int = 0, epoch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Sampling per edge type. ``seeds`` is (batch_id, ntype, node_id); every frontier node draws
    up to the fan-out from each edge type that ends in its type."""
    keys = ["etype", "src_type", "dst_type"]
    spark = typed_edges.sparkSession
    found = sorted(tuple(r) for r in typed_edges.select(*keys).distinct().collect())  # one row per edge type
    kinds = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "kind int, etype string, src_type string, dst_type string"))
    index = _typed_index(typed_edges.join(kinds, keys).select("kind", "src", "dst"))
    frontier = seeds.select("batch_id", "ntype", "node_id").distinct()
    blocks = []
    for layer in reversed(range(len(fanouts))):
        at = frontier.select("batch_id", F.col("ntype").alias("dst_type"), F.col("node_id").alias("dst"))
        asked = at.join(kinds, "dst_type").join(index.degrees, ["kind", "dst"])
        ords = pick_ordinals(F.col("deg"), fanouts[layer], seed, epoch, layer, F.col("etype"), F.col("batch_id"), F.col("dst"))
        draws = asked.select("batch_id", "kind", "dst", F.explode(ords).alias("ord"))
        drawn = draws.join(index.rows, ["kind", "dst", "ord"]).join(kinds, "kind")
        block = materialize(drawn.select("batch_id", *keys, "src", "dst"), "block")
        grown = block.select("batch_id", F.col("src_type").alias("ntype"), F.col("src").alias("node_id"))
        frontier = materialize(frontier.unionByName(grown).distinct(), "frontier")
        blocks.append(block.select("batch_id", F.lit(layer).cast("bigint").alias("layer"), *keys, "src", "dst"))
    return reduce(DataFrame.unionByName, reversed(blocks)), frontier


def _typed_index(numbered: DataFrame) -> EdgeIndex:
    """As :func:`edge_index` for (kind, src, dst): rows (kind, dst, ord, src), a large table in buckets of (kind, dst, ord)."""
    ranked = grouped_rank(numbered, ["kind", "dst"], "src", "ord").select("kind", "dst", "ord", "src")
    degrees = save(numbered.groupBy("kind", "dst").agg(F.count(F.lit(1)).alias("deg")), "typed_degrees").df
    total = degrees.agg(F.sum("deg")).first()[0] or 0
    buckets = bucket_count(numbered.sparkSession, total)
    rows = save_bucketed(ranked, "typed_index", ["kind", "dst", "ord"], buckets) if buckets else save(ranked, "typed_index")
    return EdgeIndex(rows.df, degrees)


def sample_group_neighbors(
    edges: DataFrame, groups: DataFrame, seeds: DataFrame, fanouts: Sequence[int], seed: int = 0, epoch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Sampling that takes neighbours from the seed's own groups first, then fills up.

    Our definition: own-group in-neighbours in digest order, then a uniform draw of the others.
    A uniform draw of ``fanout`` among all in-neighbours always holds enough of the others, so
    whole neighbour lists are never read.
    """
    index = edge_index(edges)
    own = groups.select(F.col("src").alias("dst"), F.col("node_id").alias("src")).filter("src != dst").distinct()
    own = materialize(own.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst"), "own")
    frontier = seeds.select("batch_id", "node_id").distinct()
    blocks = []
    for layer in reversed(range(len(fanouts))):
        fan = fanouts[layer]
        drawn = sample_layer(index, frontier, fan, seed, epoch, layer).withColumn("pref", F.lit(1))
        near = frontier.select("batch_id", F.col("node_id").alias("dst")).join(own, "dst")
        near = near.select("batch_id", "src", "dst", F.lit(0).alias("pref"))
        options = near.unionByName(drawn).groupBy("batch_id", "src", "dst").agg(F.min("pref").alias("pref"))
        order = digest(seed, epoch, layer, F.col("batch_id"), F.col("dst"), F.col("src"))
        block = top_k_per_group(options.withColumn("_h", order), ["batch_id", "dst"], [F.col("pref"), F.col("_h")], fan)
        block = materialize(block.select("batch_id", "src", "dst"), "block")
        frontier = materialize(_grow(frontier, block), "frontier")
        blocks.append(block.select("batch_id", F.lit(layer).cast("bigint").alias("layer"), "src", "dst"))
    return reduce(DataFrame.unionByName, reversed(blocks)), frontier


# Layer-wise importance sampling -------------------------------------------------


def edge_weights_by_dst(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """w = 1 / (sum of the weights entering dst); unit weights by default."""
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = materialize(edges.groupBy("dst").agg((F.lit(1.0) / F.sum(value)).alias("w")), "weights")
    return edges.select("src", "dst").join(sums, "dst").select("src", "dst", "w")


def layer_importance(edges_w: DataFrame, seeds: DataFrame, mode: str = "importance") -> DataFrame:
    """(batch_id, node_id, prob): sum of squared weights into the seeds, or 1 if there are any."""
    into = edges_w.join(seeds.select("batch_id", F.col("node_id").alias("dst")), "dst")
    value = F.sum(F.col("w") * F.col("w")) if mode == "importance" else F.max(F.lit(1.0))
    return into.groupBy("batch_id", F.col("src").alias("node_id")).agg(value.alias("prob"))


def select_layer_nodes(prob: DataFrame, k: int, seed: int = 0, layer: int = 0, replace: bool = False) -> DataFrame:
    """``k`` candidates per batch in proportion to ``prob``.

    Without replacement: the k largest keys ln(u)/prob (weighted reservoir law, the same as
    drawing one by one). With replacement: k inverse-CDF draws; the result lists each draw.
    """
    live = prob.filter("prob > 0")
    if not replace:
        key = F.log(uniform(seed, layer, F.col("batch_id"), F.col("node_id"))) / F.col("prob")
        keyed = live.withColumn("_key", key)
        top = top_k_per_group(keyed, ["batch_id"], [F.col("_key").desc(), F.col("node_id")], k)
        return top.select("batch_id", "node_id", "prob")
    return _draw_with_replacement(live, k, seed, layer)


def _locate(draws: DataFrame, intervals: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """The interval each draw falls into: (*keys, slot, u, hit).

    ``draws`` is (*keys, slot, u), ``intervals`` is (*keys, id, lo, hi), all within [0, 1]. An
    interval lists the equal cells it touches, so the lookup is an equality join; of the
    intervals starting at or before the draw the last one is taken, so rounding at an end can
    neither lose nor repeat a draw.
    """
    grid = F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))
    covered = intervals.withColumn("_cell", F.explode(grid))
    placed = draws.withColumn("_cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    near = placed.join(covered, [*keys, "_cell"]).filter("lo <= u")
    return near.groupBy(*keys, "slot", "u").agg(F.max(F.struct("lo", "id", "hi")).alias("hit"))


def _draw_with_replacement(live: DataFrame, k: int, seed: int, layer: int) -> DataFrame:
    """k inverse-CDF draws per batch over k cells: about one draw per cell, so the join yields
    about one row per candidate and draw."""
    ranked = materialize(grouped_rank(live, ["batch_id"], "node_id", "_i"), "cdf")
    ends = _running_by_batch(ranked)
    totals = materialize(ends.groupBy("batch_id").agg(F.max("_hi").alias("_total")), "totals")
    intervals = ends.join(totals, "batch_id").select(
        "batch_id", F.col("node_id").alias("id"), (F.col("_lo") / F.col("_total")).alias("lo"), (F.col("_hi") / F.col("_total")).alias("hi"))
    draws = totals.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    draws = draws.withColumn("u", uniform(seed, layer, F.col("batch_id"), F.col("slot")))
    hits = _locate(draws, intervals, ["batch_id"], k)
    hits = hits.select("batch_id", F.col("slot").alias("draw"), F.col("hit.id").alias("node_id"))
    return hits.join(live.select("batch_id", "node_id", "prob"), ["batch_id", "node_id"])


def _running_by_batch(ranked: DataFrame, block: int = 1 << 16) -> DataFrame:
    from pyspark.sql.window import Window as W

    cut = ranked.withColumn("_blk", F.floor(F.col("_i") / F.lit(block)))
    sums = cut.groupBy("batch_id", "_blk").agg(F.sum("prob").alias("_s"))
    before = W.partitionBy("batch_id").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select("batch_id", "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base"))
    within = W.partitionBy("batch_id", "_blk").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_run", F.sum("prob").over(within)).join(carry, ["batch_id", "_blk"])
    hi = F.col("_base") + F.col("_run")
    return local.select("batch_id", "node_id", "prob", (hi - F.col("prob")).alias("_lo"), hi.alias("_hi"))


def layer_block(edges_w: DataFrame, picked: DataFrame, seeds: DataFrame) -> DataFrame:
    """(batch_id, src, dst, w): edges from picked nodes to seeds, w / prob(src) scaled so that
    the weights into a dst add up to its in-degree inside the block."""
    kept = edges_w.join(seeds.select("batch_id", F.col("node_id").alias("dst")), "dst")
    chosen = picked.select("batch_id", F.col("node_id").alias("src"), "prob").distinct()
    kept = kept.join(chosen, ["batch_id", "src"])
    # Written, as is the sum: a join splits a hub only when both of its sides are shuffled for it.
    kept = materialize(kept.select("batch_id", "src", "dst", (F.col("w") / F.col("prob")).alias("_t")), "kept")
    sums = kept.groupBy("batch_id", "dst").agg((F.count(F.lit(1)) / F.sum("_t")).alias("_scale"))
    return kept.join(materialize(sums, "scales"), ["batch_id", "dst"]).select(
        "batch_id", "src", "dst", (F.col("_t") * F.col("_scale")).alias("w")
    )


def sample_layerwise(
    edges_w: DataFrame, seeds: DataFrame, nodes_per_layer: Sequence[int], seed: int = 0,
    mode: str = "importance", replace: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Importance, selection and block per layer from last to first; the next seeds are the
    picked nodes together with the current seeds. Returns (weighted blocks, input nodes)."""
    frontier = seeds.select("batch_id", "node_id").distinct()
    blocks = []
    for layer in reversed(range(len(nodes_per_layer))):
        prob = materialize(layer_importance(edges_w, frontier, mode), "prob")
        picked = materialize(select_layer_nodes(prob, nodes_per_layer[layer], seed, layer, replace), "picked")
        block = materialize(layer_block(edges_w, picked, frontier), "block")
        frontier = materialize(frontier.unionByName(picked.select("batch_id", "node_id")).distinct(), "frontier")
        blocks.append(block.select("batch_id", F.lit(layer).cast("bigint").alias("layer"), "src", "dst", "w"))
    return reduce(DataFrame.unionByName, reversed(blocks)), frontier


# Partitions ---------------------------------------------------------------------


def propagate_labels(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(node_id, comm): each round a node takes the commonest label among its neighbours in
    either direction, the smallest on ties; a node without neighbours keeps its own."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(both.filter("src != dst").distinct(), "both")
    comm = nodes.select("node_id", F.col("node_id").alias("comm"))
    for _ in range(rounds):
        votes = both.join(comm.withColumnRenamed("node_id", "src"), "src")
        votes = votes.groupBy(F.col("dst").alias("node_id"), "comm").agg(F.count(F.lit(1)).alias("n"))
        kept = comm.select("node_id", "comm", F.lit(0).cast("bigint").alias("n"))
        best = F.max(F.struct("n", (-F.col("comm")).alias("m")))
        comm = votes.unionByName(kept).groupBy("node_id").agg(best.alias("b"))
        comm = materialize(comm.select("node_id", (-F.col("b.m")).alias("comm")), "comm")
    return comm


def assign_partitions(edges: DataFrame, nodes: DataFrame, k: int, rounds: int = 3) -> DataFrame:
    """(node_id, part): communities laid end to end, large ones first, and cut into ``k`` parts
    of equal size (they differ by at most one node)."""
    from nodeloom.plans.scan import global_rank

    comm = propagate_labels(edges, nodes, rounds)
    # Written, so that a giant community is split by the join with its size.
    sizes = materialize(comm.groupBy("comm").agg(F.count(F.lit(1)).alias("size")), "sizes")
    placed = save(comm.join(sizes, "comm"), "comm_sizes")
    ranked = global_rank(placed.df, [F.col("size").desc(), F.col("comm"), F.col("node_id")])
    return ranked.select("node_id", F.floor(F.col("rank") * F.lit(k) / F.lit(max(placed.rows, 1))).cast("bigint").alias("part"))


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose ends lie in different parts, and all edges."""
    a = parts.select(F.col("node_id").alias("src"), F.col("part").alias("_a"))
    b = parts.select(F.col("node_id").alias("dst"), F.col("part").alias("_b"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.agg(F.count_if(F.col("_a") != F.col("_b")).alias("cut"), F.count(F.lit(1)).alias("edges"))


def cluster_batches(parts: DataFrame, per_batch: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(batch_id, node_id): every batch is the union of ``per_batch`` partitions in seeded order."""
    from nodeloom.plans.scan import hash_rank

    ids = parts.select("part").distinct().withColumn("_h", digest(seed, epoch, F.col("part")))
    order = hash_rank(ids, "_h", "part").select("part", F.floor(F.col("rank") / F.lit(per_batch)).cast("bigint").alias("batch_id"))
    return parts.join(order, "part").select("batch_id", "node_id")


def induced_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(batch_id, src, dst): edges with both ends in the batch's node set."""
    a = members.select("batch_id", F.col("node_id").alias("src"))
    b = members.select("batch_id", F.col("node_id").alias("dst"))
    return edges.select("src", "dst").join(a, "src").join(b, ["batch_id", "dst"], "left_semi").select("batch_id", "src", "dst")


# Access patterns ----------------------------------------------------------------


def access_pattern(slots: DataFrame, n: int, kind: str, seed: int = 0, stride: int = 1, s: float = 1.8,
                   rows_per_page: int = 1) -> DataFrame:
    """(slot, pos): one position in [0, n) per slot: ``sequential``, ``strided``, ``uniform`` or
    ``zipf`` (power law over pages, rank 1 being page 0)."""
    slot = F.col("slot")
    if kind == "zipf":
        return _zipf(slots, n, seed, s, rows_per_page)
    pos = {
        "sequential": slot % F.lit(n),
        "strided": (slot * F.lit(stride)) % F.lit(n),
        "uniform": hash_long(seed, slot) % F.lit(n),
    }[kind]
    return slots.select("slot", pos.cast("bigint").alias("pos"))


def _zipf(slots: DataFrame, n: int, seed: int, s: float, rows_per_page: int, block: int = 1 << 16) -> DataFrame:
    """Inverse CDF of 1/rank^s over pages, found in two steps: the block of pages, then the page.

    The tail of a power law puts very many pages into the last equal cell of [0, 1); inside a
    block the pages are alike, so its own cells hold few.
    """
    pages = max(n // rows_per_page, 1)
    table = slots.sparkSession.range(pages).select(F.col("id").alias("page"), F.pow(F.col("id") + 1.0, F.lit(-s)).alias("w"))
    cdf = materialize(prefix_scan(table, "page", "w", "hi", block=block), "cdf")
    cdf = cdf.withColumn("blk", F.floor(F.col("page") / F.lit(block)))
    total = cdf.agg(F.max("hi")).first()[0]
    blocks = cdf.groupBy("blk").agg(F.min(F.col("hi") - F.col("w")).alias("from"), F.max("hi").alias("to"))
    blocks = materialize(blocks, "blocks")
    draws = slots.select("slot", uniform(seed, F.col("slot")).alias("u"))
    tops = blocks.select(F.col("blk").alias("id"), (F.col("from") / F.lit(total)).alias("lo"), (F.col("to") / F.lit(total)).alias("hi"))
    found = _locate(draws, tops, [], block)
    inner = (F.col("u") - F.col("hit.lo")) / (F.col("hit.hi") - F.col("hit.lo"))
    found = found.select("slot", F.col("hit.id").alias("blk"), F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0)).alias("u"))
    span = F.col("to") - F.col("from")
    within = cdf.join(blocks, "blk").select(
        "blk", F.col("page").alias("id"), F.greatest((F.col("hi") - F.col("w") - F.col("from")) / span, F.lit(0.0)).alias("lo"),
        ((F.col("hi") - F.col("from")) / span).alias("hi"))
    hits = _locate(found, within, ["blk"], block)
    return hits.select("slot", (F.col("hit.id") * F.lit(rows_per_page)).cast("bigint").alias("pos"))


def gather_sum(positions: DataFrame, arr: DataFrame, value: str = "v") -> DataFrame:
    """Total of the values read at the given positions; positions are counted before the join,
    so a position read a billion times is one row."""
    reads = positions.groupBy("pos").agg(F.count(F.lit(1)).alias("_c"))
    joined = reads.join(arr.select(F.col("i").alias("pos"), value), "pos")
    return joined.agg(F.sum("_c").alias("reads"), F.sum(F.col("_c") * F.col(value)).alias("total"))
