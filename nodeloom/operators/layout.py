"""Grouping neighbours and re-ordering the feature table.

The grouping rule is a walk over the nodes in a given order in which each takes its first
unused neighbours. The same groups come out of parallel rounds: every waiting source puts
its rank on all nodes it could still take, each node keeps the lowest rank, and a source
takes those of its own that are in its groups whatever becomes of the others. Whoever could
interfere comes earlier in the order and would hold a lower rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.operators.gather import gather_features
from nodeloom.operators.ordering import processing_order, top_low_degree
from nodeloom.operators.sampling import khop_full
from nodeloom.operators.sets import (
    add_self_loops, compress_with_supernodes, pairwise_overlap, split_edges_by_nodes, validate_groups,
)
from nodeloom.operators.stats import degrees, graph_stats, in_neighborhoods, neighborhood_sizes, storage_report
from nodeloom.plans.scan import global_rank, grouped_rank, prefix_scan, top_k_per_group
from nodeloom.plans.skew import shuffled
from nodeloom.plans.store import Saved, materialize, save

_LAST = (1 << 62) - 1


def neighbor_order(edges: DataFrame) -> DataFrame:
    """(src, dst, npos): neighbours by id, the self loop at the end of the list."""
    npos = F.when(F.col("src") == F.col("dst"), F.lit(_LAST)).otherwise(F.col("dst"))
    return edges.select("src", "dst").distinct().withColumn("npos", npos.cast("bigint"))


def rank_neighbors(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(src, dst, npos): distinct neighbours by descending score, then id.

    Scores are turned into one global rank per node first; inside a source the order is then
    an integer range and a hub's list can be cut into blocks.
    """
    ranked = materialize(global_rank(scores, [F.col("score").desc(), F.col("node_id")], "_g").select(
        F.col("node_id").alias("dst"), "_g"), "score_rank")
    listed = materialize(edges.select("src", "dst").distinct().join(ranked, "dst"), "listed")
    return grouped_rank(listed, ["src"], "_g", "npos").select("src", "dst", "npos")


def chunk_groups(ranked: DataFrame, k: int, max_groups: int) -> DataFrame:
    """(src, g, slot, node_id): each ranked list cut into full k-tuples, at most ``max_groups``.

    Only the first ``k * max_groups`` neighbours matter, whatever the list's length.
    """
    head = top_k_per_group(ranked, ["src"], [F.col("npos")], k * max_groups)
    placed = head.select(
        "src", F.floor((F.col("rn") - 1) / F.lit(k)).cast("bigint").alias("g"),
        ((F.col("rn") - 1) % F.lit(k)).cast("bigint").alias("slot"), F.col("dst").alias("node_id"),
    )
    # At most k rows per window group, and the rows already lie by src.
    size = F.count(F.lit(1)).over(W.partitionBy("src", "g"))
    return placed.withColumn("_n", size).filter(F.col("_n") == k).drop("_n")


def _walk(adj: DataFrame, order: DataFrame, k: int, max_groups: int, exclusive: bool) -> DataFrame:
    """(group_id, src, slot, node_id) of the greedy walk; ``exclusive`` drops used sources.

    A node that a source holds is free when its turn comes, so ``c`` nodes taken and ``h`` held make at least
    ``(c + h) // k`` groups; what lies within them is taken at once, whatever becomes of the nodes not held. As many
    groups as the list could fill at best are the most, and nothing behind their last held node is claimed any longer.
    """
    most = k * max_groups
    ranks = order.select(F.col("node_id").alias("src"), "rank")
    # A neighbour or a node listed twice counts at its first place: the rounds know one holder and one copy of a node.
    start = adj.select("src", "dst", "npos").join(ranks, "src").groupBy("src", "dst").agg(F.min("npos").alias("npos"), F.min("rank").alias("rank"))
    start = start.withColumn("done", F.lit(0).cast("bigint"))
    live = save(_listed(start, k, most), "live")
    commits: list[Saved] = []
    while live.rows:
        heads = save(_heads(live.df, k, most, exclusive), "heads")
        batch = save(heads.df.filter("taken").select("src", "rank", "npos", F.col("dst").alias("node_id")), "commits")
        commits.append(batch)
        following = save(_listed(_left(live.df, heads.df, batch.df, exclusive), k, most), "live")
        heads.drop()
        live.drop()
        live = following
    if not commits:
        return live.df.select(F.col("rank").alias("group_id"), "src", F.col("npos").alias("slot"), F.col("dst").alias("node_id"))
    every = reduce(DataFrame.unionByName, [c.df for c in commits])
    # At most k * max_groups rows per window group.
    placed = every.withColumn("i", F.row_number().over(W.partitionBy("src", "rank").orderBy("npos")) - 1)
    placed = materialize(placed.select(
        "src", "rank", F.floor(F.col("i") / F.lit(k)).cast("bigint").alias("g"), (F.col("i") % F.lit(k)).cast("bigint").alias("slot"), "node_id",
    ), "placed")
    for c in commits:
        c.drop()
    ids = global_rank(placed.filter("slot = 0").select("src", "rank", "g"), [F.col("rank"), F.col("g")], "group_id")
    return placed.join(shuffled(ids.select("src", "g", "group_id")), ["src", "g"]).select("group_id", "src", "slot", "node_id")


def _fills(taken: Column, free: Column, k: int, most: int) -> Column:
    """Members of the groups that a source makes with ``free`` nodes besides those it has taken."""
    return F.least(F.lit(most), F.floor((taken + free) / F.lit(k)) * F.lit(k))


def _listed(live: DataFrame, k: int, most: int) -> DataFrame:
    """``live`` with the place ``rn`` in what is left of a source's list and its length, for sources that can still fill a group."""
    mine = W.partitionBy("src")
    listed = live.withColumn("rn", F.row_number().over(mine.orderBy("npos")).cast("bigint")).withColumn("len", F.count(F.lit(1)).over(mine))
    return listed.filter(_fills(F.col("done"), F.col("len"), k, most) > F.col("done"))


def _heads(live: DataFrame, k: int, most: int, exclusive: bool) -> DataFrame:
    """(src, rank, dst, npos, taken, after, cut): the first nodes a source holds and which of them it takes now.

    ``after`` counts the nodes it has then; its list ends at ``cut`` if that is given. A node has one holder, so
    this is a table of nodes, not of edges.
    """
    none = F.lit(None).cast("bigint")
    sources = live.filter("rn = 1").select("src", "rank", "done", "len")
    claims = live.select(F.col("dst").alias("node_id"), "rank", "rn", "npos", none.alias("self"))
    if exclusive:  # until it has taken any, a source's own node must not go to an earlier one
        claims = claims.unionByName(sources.filter("done = 0").select(
            F.col("src").alias("node_id"), none.alias("rank"), none.alias("rn"), none.alias("npos"), F.col("rank").alias("self")))
    # Fixed-width buffers, so that the claims are combined by hashing.
    holders = claims.groupBy("node_id").agg(
        F.min("rank").alias("rank"), F.min_by("rn", "rank").alias("rn"), F.min_by("npos", "rank").alias("npos"), F.min("self").alias("self"))
    if exclusive:  # a source that holds its own node holds it as one more row of place 0
        own = F.col("self").isNotNull() & (F.col("rank").isNull() | (F.col("self") <= F.col("rank")))
        held = F.col("rank").isNotNull() & (F.col("self").isNull() | (F.col("rank") <= F.col("self")))
        zero = F.lit(0).cast("bigint")
        edge = F.struct("rank", "rn", "npos", F.col("node_id").alias("dst"))
        self_ = F.struct(F.col("self").alias("rank"), zero.alias("rn"), none.alias("npos"), none.alias("dst"))
        both = F.filter(F.array(F.when(held, edge), F.when(own, self_)), lambda x: x.isNotNull())
        rows = holders.select(F.explode(both).alias("x")).select("x.*")
        top = top_k_per_group(rows, ["rank"], [F.col("rn")], most + 1, "hp")
    else:
        top = top_k_per_group(holders.select("rank", "rn", "npos", F.col("node_id").alias("dst")), ["rank"], [F.col("rn")], most, "hp")
    top = top.join(shuffled(sources), "rank")
    mine = W.partitionBy("rank")  # at most ``most`` + 1 rows
    if exclusive:
        top = top.withColumn("own", F.max(F.col("rn") == 0).over(mine))
        top = top.withColumn("hp", F.col("hp") - F.when(F.col("own"), F.lit(1)).otherwise(F.lit(0))).filter("rn > 0")
    else:
        top = top.withColumn("own", F.lit(True))
    top = top.withColumn("sure", _fills(F.col("done"), F.count(F.lit(1)).over(mine), k, most))
    top = top.withColumn("taken", (F.col("own") | (F.col("done") > 0)) & (F.col("rn") <= F.col("sure") - F.col("done")))
    fresh = F.count(F.when(F.col("taken"), F.lit(1))).over(mine)
    top = top.withColumn("after", F.col("done") + fresh)
    # Taken nodes are held ones, so the length that is left and they together are the length before.
    best = _fills(F.col("done"), F.col("len"), k, most)
    cut = F.max(F.when(F.col("hp") == best - F.col("done"), F.col("npos"))).over(mine)
    return top.withColumn("cut", cut).select("src", "rank", "dst", "npos", "taken", "after", "cut")


def _left(live: DataFrame, heads: DataFrame, taken: DataFrame, exclusive: bool) -> DataFrame:
    """What is left of the lists after a round: neither nodes in use, nor what lies behind a cut, nor used sources."""
    turns = heads.select("src", "after", "cut", F.lit(0).alias("used"))
    if exclusive:
        none = F.lit(None).cast("bigint")
        turns = turns.unionByName(taken.select(F.col("node_id").alias("src"), none.alias("after"), none.alias("cut"), F.lit(1).alias("used")))
    turns = turns.groupBy("src").agg(F.max("after").alias("after"), F.max("cut").alias("cut"), F.max("used").alias("used"))
    rest = live.select("src", "dst", "npos", "rank", "done").join(taken.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    rest = rest.join(turns, "src", "left").withColumn("done", F.coalesce("after", "done"))
    rest = rest.filter((F.col("cut").isNull() | (F.col("npos") <= F.col("cut"))) & (F.coalesce("used", F.lit(0)) * (F.col("done") == 0).cast("int") == 0))
    return rest.select("src", "dst", "npos", "rank", "done")


def group_neighbors(adj: DataFrame, order: DataFrame, k: int = 4) -> DataFrame:
    """(group_id, src, slot, node_id): disjoint groups, one per source, used nodes skipped.

    ``adj`` is (src, dst, npos), ``order`` is (node_id, rank).
    """
    return _walk(adj, order, k, 1, True)


def group_neighbors_multi(adj: DataFrame, order: DataFrame, k: int = 4, max_groups: int = 5) -> DataFrame:
    """As :func:`group_neighbors` with up to ``max_groups`` per source; used nodes stay sources."""
    return _walk(adj, order, k, max_groups, False)


def _append(groups: DataFrame, extra: DataFrame, order_col: str) -> DataFrame:
    """Number the extra groups (key columns, ``order_col``, g) after the existing ones."""
    start = groups.select("group_id").distinct().count()
    extra = materialize(extra, "extra")
    ids = global_rank(extra.filter("slot = 0").select("src", "g", order_col), [F.col(order_col), F.col("g")], "_i")
    numbered = extra.join(shuffled(ids.select("src", "g", "_i")), ["src", "g"])
    numbered = numbered.select((F.col("_i") + F.lit(start)).alias("group_id"), "src", "slot", "node_id")
    return groups.select("group_id", "src", "slot", "node_id").unionByName(numbered)


def fill_groups(adj: DataFrame, groups: DataFrame, nodes: DataFrame, k: int = 4, redundancy: float = 0.2) -> DataFrame:
    """Add groups for uncovered nodes until slots / N reaches ``1 + redundancy``.

    Uncovered nodes with at least k neighbours come by id, each with its first k neighbours,
    covered or not; the test is made before each. A node's first covering candidate is a
    minimum, so the storage before every candidate is one running total.
    """
    groups = materialize(groups, "groups")
    n = nodes.count()
    covered = groups.select("node_id").distinct()
    open_nodes = nodes.select("node_id").join(covered, "node_id", "left_anti")
    mine = adj.join(open_nodes.select(F.col("node_id").alias("src")), "src", "left_semi")
    cand = materialize(chunk_groups(mine, k, 1), "cand")
    first = cand.groupBy("node_id").agg(F.min("src").alias("src")).join(covered, "node_id", "left_anti")
    fresh = first.groupBy("src").agg(F.count(F.lit(1)).alias("fresh"))
    grown = cand.filter("slot = 0").select("src").join(fresh, "src", "left")
    grown = grown.select("src", (F.lit(k) - F.coalesce("fresh", F.lit(0))).cast("bigint").alias("grow"))
    before = prefix_scan(grown, "src", "grow", "before", inclusive=False)
    start = storage_report(groups, nodes).first()["total_slots"]
    taken = before.filter((F.lit(float(start)) + F.col("before")) / F.lit(float(n)) < 1 + redundancy).select("src")
    extra = cand.join(taken, "src", "left_semi").withColumn("_o", F.col("src"))
    return _append(groups, extra, "_o")


def fill_groups_multi(ranked: DataFrame, groups: DataFrame, order: DataFrame, k: int = 4, max_groups: int = 5,
                      redundancy: float = 0.2) -> DataFrame:
    """Fill every node up to ``max_groups`` with consecutive k-slices of its ranked list.

    Nodes come in processing order; the stop test follows each node under its cap, so the
    first of them is always served.
    """
    groups = materialize(groups, "groups")
    order = materialize(order.select("node_id", "rank"), "order")
    n = order.count()
    have = groups.filter("slot = 0").groupBy("src").agg(F.count(F.lit(1)).alias("cur"))
    active = order.withColumnRenamed("node_id", "src").join(have, "src", "left")
    active = materialize(active.select("src", "rank", F.coalesce("cur", F.lit(0)).alias("cur")).filter(F.col("cur") < max_groups), "active")
    cand = chunk_groups(ranked, k, max_groups).join(active, "src")
    cand = materialize(cand.filter(F.col("g") < max_groups - F.col("cur")), "cand")
    covered = groups.select("node_id").distinct()
    first = cand.groupBy("node_id").agg(F.min("rank").alias("rank")).join(covered, "node_id", "left_anti")
    fresh = first.groupBy("rank").agg(F.count(F.lit(1)).alias("fresh"))
    slots = cand.groupBy("rank").agg(F.count(F.lit(1)).alias("slots"))
    grown = active.select("src", "rank").join(slots, "rank", "left").join(fresh, "rank", "left")
    grown = grown.select("src", "rank", (F.coalesce("slots", F.lit(0)) - F.coalesce("fresh", F.lit(0))).alias("grow"))
    before = prefix_scan(grown, "rank", "grow", "before", inclusive=False)
    start = storage_report(groups, order).first()["total_slots"]
    lead = active.agg(F.min("rank")).first()[0]
    limit = int(n * (1 + redundancy))
    served = before.filter((F.col("rank") == F.lit(lead)) | (F.col("before") + F.lit(start) < limit)).select("src")
    extra = cand.join(served, "src", "left_semi").drop("cur").withColumnRenamed("rank", "_o")
    return _append(groups, extra, "_o")


def node_sequence(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, node_id): group members in group order, repeats kept, then uncovered nodes by id."""
    zero = F.lit(0).cast("bigint")
    members = groups.select(F.lit(0).alias("k"), "group_id", "slot", "node_id")
    rest = nodes.select("node_id").join(groups.select("node_id"), "node_id", "left_anti")
    rest = rest.select(F.lit(1).alias("k"), zero.alias("group_id"), zero.alias("slot"), "node_id")
    order = [F.col(c) for c in ("k", "group_id", "slot", "node_id")]
    return global_rank(members.unionByName(rest), order, "pos").select("pos", "node_id")


def reorder_features(features: DataFrame, layout: DataFrame) -> DataFrame:
    """(pos, feat): feat[layout[pos]], range-partitioned and sorted by position for writing."""
    placed = gather_features(layout.select("pos", "node_id"), features).select("pos", "feat")
    return placed.repartitionByRange("pos").sortWithinPartitions("pos")


def layout_from_sets(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, node_id): first occurrence over the sets in order, then all other nodes by id.

    ``sets`` is (set_rank, pos, node_id).
    """
    key = sets.groupBy("node_id").agg(F.min(F.struct("set_rank", "pos")).alias("k"))
    placed = nodes.select("node_id").join(key, "node_id", "left")
    order = [F.col("k.set_rank").asc_nulls_last(), F.col("k.pos").asc_nulls_last(), F.col("node_id")]
    return global_rank(placed, order, "pos").select("pos", "node_id")


#: Nearest sets of every set that the driver holds while it chains.
NEAR = 16


def chain_sets(overlap: DataFrame, count: int, near: int = NEAR) -> list[int]:
    """Order of the sets 0 to ``count`` - 1: from set 0 always to the unvisited set sharing most, lowest on ties.

    ``overlap`` is (i, j, n) for both directions of every pair that shares any; it stays a written
    table. The driver holds the ``near`` best unvisited neighbours of each set, at most ``count * near`` rows,
    and draws the lists again from the table, for the sets that are left, when one of them is used up.
    """
    table = save(overlap.select("i", "j", "n"), "overlap")
    chain, used, lists, whole = list(range(min(count, 1))), {0}, {}, set()
    lowest = 1

    def draw() -> None:
        left = table.df
        gone = table.df.sparkSession.createDataFrame([(x,) for x in used], "j bigint")
        left = left.join(gone, "j", "left_anti").join(gone.filter(F.col("j") != chain[-1]).withColumnRenamed("j", "i"), "i", "left_anti")
        best = top_k_per_group(left, ["i"], [F.desc("n"), F.col("j")], near).select("i", "j", "rn")
        lists.clear()
        whole.clear()
        for row in sorted(best.collect(), key=lambda r: (r["i"], r["rn"])):
            lists.setdefault(row["i"], []).append(row["j"])
        whole.update(i for i, js in lists.items() if len(js) < near)

    drawn = False
    while 0 < len(chain) < count:
        here = chain[-1]
        following = next((j for j in lists.get(here, []) if j not in used), None)
        if following is None and (not drawn or (here in lists and here not in whole)):
            draw()
            drawn = True
            continue
        if following is None:  # nothing shared with any set that is left
            while lowest in used:
                lowest += 1
            following = lowest
        chain.append(following)
        used.add(following)
    table.drop()
    return chain


def seed_sets(edges: DataFrame, nodes: DataFrame, hops: int, below: int, k: int) -> DataFrame:
    """(set_id, node_id, pos): the k-hop sets of the largest low-degree nodes, seed first."""
    top = top_low_degree(edges, nodes, below, k)
    seeds = materialize(top.select(F.col("rank").alias("set_id"), "node_id"), "seeds")
    sets = khop_full(edges, seeds, hops)
    own = seeds.withColumnRenamed("node_id", "seed")
    pos = F.when(F.col("node_id") == F.col("seed"), F.lit(-1)).otherwise(F.col("node_id")).cast("bigint")
    return sets.join(own, "set_id").select("set_id", "node_id", pos.alias("pos"))


def reorganize_graph(edges: DataFrame, nodes: DataFrame, hops: int, below: int = 8, k: int = 100) -> DataFrame:
    """(pos, node_id): sets of related nodes chained by overlap, then everything else.

    The driver sees the order of the k sets and a few nearest sets of each (:func:`chain_sets`).
    """
    sets = materialize(seed_sets(edges, nodes, hops, below, k), "sets")
    chain = chain_sets(pairwise_overlap(sets), sets.select("set_id").distinct().count())
    ranks = edges.sparkSession.createDataFrame([(s, i) for i, s in enumerate(chain)], "set_id bigint, set_rank bigint")
    return layout_from_sets(sets.join(F.broadcast(ranks), "set_id").select("set_rank", "pos", "node_id"), nodes)


def colocated_slots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pos, node_id, slot, member): each node and its in-neighbours laid out one after another."""
    starts = prefix_scan(neighborhood_sizes(edges, nodes), "node_id", "size", "start", inclusive=False)
    slots = in_neighborhoods(edges, nodes).join(starts.select("node_id", "start"), "node_id")
    return slots.select((F.col("start") + F.col("slot")).cast("bigint").alias("pos"), "node_id", "slot", "member")


def colocate_neighbors(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(pos, node_id, member, feat): features of [self, in-neighbours] in layout order."""
    slots = colocated_slots(edges, features).drop("slot")
    wide = features.select(F.col("node_id").alias("member"), "feat")
    return slots.join(wide, "member").select("pos", "node_id", "member", "feat")


def prepare_layout(edges: DataFrame, nodes: DataFrame, features: DataFrame, scores: DataFrame, hot: DataFrame,
                   k: int = 4, redundancy: float = 0.2) -> dict[str, DataFrame]:
    """The whole offline job: statistics, self loops, removal of hot nodes, grouping, filling,
    validation, edge compression, node sequence and re-ordered features."""
    looped = materialize(add_self_loops(edges, nodes, "missing"), "looped")
    _, cold = split_edges_by_nodes(looped, hot)
    cold = materialize(cold, "cold")
    adj = materialize(neighbor_order(cold), "adj")
    order = processing_order(degrees(cold, nodes, "out").join(scores, "node_id"), "degree_asc")
    first = group_neighbors(adj, order, k)
    groups = materialize(fill_groups(adj, first, nodes, k, redundancy), "groups")
    sequence = materialize(node_sequence(groups, nodes), "sequence")
    top = nodes.agg(F.max("node_id")).first()[0]
    return {
        "stats": graph_stats(edges),
        "groups": groups,
        "check": validate_groups(groups, edges),
        "storage": storage_report(groups, nodes),
        "edges": compress_with_supernodes(looped, groups, top + 1),
        "sequence": sequence,
        "features": reorder_features(features, sequence),
    }


def degree_order(edges: DataFrame, nodes: DataFrame, scores: DataFrame, mode: str) -> DataFrame:
    """Processing order over out-degrees (distinct neighbours) and scores."""
    return processing_order(degrees(edges, nodes, "out").join(scores, "node_id"), mode)


def uniform_groups(groups: DataFrame, columns: Sequence[str] = ("group_id", "src", "slot", "node_id")) -> DataFrame:
    """Groups as plain bigint columns."""
    return groups.select(*[F.col(c).cast("bigint").alias(c) for c in columns])
