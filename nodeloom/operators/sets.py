"""Set operations on nodes and edges, group checks and table comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.plans.store import materialize


def add_self_loops(edges: DataFrame, nodes: DataFrame, mode: str = "always") -> DataFrame:
    """Every node gets (i, i). ``always`` appends it, ``missing`` only where absent."""
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    if mode == "missing":
        loops = loops.join(edges.filter("src = dst").select("src").distinct(), "src", "left_anti").select("src", "dst")
    return edges.select("src", "dst").unionByName(loops)


def union_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sorted distinct union of two id sets."""
    return a.select("node_id").union(b.select("node_id")).distinct().orderBy("node_id")


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node_id").intersect(b.select("node_id"))


def uncovered_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes in no group, ascending."""
    return nodes.select("node_id").join(groups.select("node_id"), "node_id", "left_anti").orderBy("node_id")


def split_edges_by_nodes(edges: DataFrame, remove: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose destination is inside / outside the remove set."""
    ids = remove.select(F.col("node_id").alias("dst"))
    return edges.join(ids, "dst", "left_semi").select("src", "dst"), edges.join(ids, "dst", "left_anti").select("src", "dst")


def split_degrees(edges: DataFrame, nodes: DataFrame, remove: DataFrame) -> DataFrame:
    """Per node, how many of its neighbours are inside / outside the remove set; all nodes kept."""
    flag = remove.select(F.col("node_id").alias("dst"), F.lit(1).alias("_in")).distinct()
    marked = edges.join(flag, "dst", "left").select(
        F.col("src").alias("node_id"),
        F.coalesce("_in", F.lit(0)).cast("bigint").alias("_a"),
        (1 - F.coalesce("_in", F.lit(0))).cast("bigint").alias("_b"),
    )
    zero = F.lit(0).cast("bigint")
    both = marked.unionByName(nodes.select("node_id", zero.alias("_a"), zero.alias("_b")))
    return both.groupBy("node_id").agg(F.sum("_a").alias("n_in"), F.sum("_b").alias("n_out"))


def pairwise_overlap(sets: DataFrame, tile: int = 1024) -> DataFrame:
    """(i, j, n): members shared by sets i and j, for every i != j that share any.

    ``sets`` is (set_id, node_id), distinct. Rows are grouped by node, and each task adds up
    products of small incidence blocks (nodes x sets), so a node in many sets never becomes
    a list of pairs; only the per-task counts are exchanged.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"node_id": [], "set_id": []}, dtype="int64")
        for pdf in frames:
            pdf = pd.concat([held, pdf], ignore_index=True)
            last = pdf["node_id"].iloc[-1]
            held = pdf[pdf["node_id"] == last]
            yield from blocks(pdf[pdf["node_id"] != last])
        yield from blocks(held)

    def blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if pdf.empty:
            return
        rows, _ = pd.factorize(pdf["node_id"])
        ids, cols = np.unique(pdf["set_id"].to_numpy(), return_inverse=True)
        for a in range(0, len(ids), tile):
            left = _incidence(rows, cols, a, tile, len(ids))
            for b in range(a, len(ids), tile):
                right = left if a == b else _incidence(rows, cols, b, tile, len(ids))
                shared = left.T @ right
                i, j = np.nonzero(shared)
                keep = ids[a + i] < ids[b + j]
                yield pd.DataFrame({"i": ids[a + i[keep]], "j": ids[b + j[keep]],
                                    "n": shared[i[keep], j[keep]].astype("int64")})

    placed = sets.select("node_id", "set_id").repartition("node_id").sortWithinPartitions("node_id")
    partial = placed.mapInPandas(count, "i bigint, j bigint, n bigint")
    upper = partial.groupBy("i", "j").agg(F.sum("n").alias("n"))
    pair = F.explode(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    return upper.select(pair.alias("p")).select("p.i", "p.j", "p.n")


def _incidence(rows: np.ndarray, cols: np.ndarray, start: int, tile: int, total: int) -> np.ndarray:
    inside = (cols >= start) & (cols < start + tile)
    block = np.zeros((rows.max() + 1, min(tile, total - start)), dtype=np.float32)
    block[rows[inside], cols[inside] - start] = 1.0
    return block


def invalid_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of groups with a member that is neither the source itself nor its neighbour."""
    members = groups.filter(F.col("node_id") != F.col("src")).select("group_id", "src", F.col("node_id").alias("dst"))
    return members.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("group_id").distinct()


def validate_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(total, valid, invalid) group counts for groups as (group_id, src, slot, node_id)."""
    bad = invalid_groups(groups, edges).withColumn("_bad", F.lit(1))
    flags = groups.select("group_id").distinct().join(bad, "group_id", "left")
    return flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_bad").isNull()).alias("valid"),
        F.count("_bad").alias("invalid"),
    )


def diff_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or exist on one side only: (key, left_value, right_value)."""
    left = a.select(key, F.col(value).alias("left_value"))
    right = b.select(key, F.col(value).alias("right_value"))
    joined = left.join(right, key, "full_outer")
    return joined.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def compress_with_supernodes(edges: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Replace the edges covered by groups with one edge per group to node ``n + group_id``."""
    covered = groups.select("src", F.col("node_id").alias("dst"))
    kept = edges.select("src", "dst").join(covered, ["src", "dst"], "left_anti")
    links = groups.select("group_id", "src").distinct()
    return kept.unionByName(links.select("src", (F.col("group_id") + F.lit(n)).alias("dst")))


def supernode_report(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Expected against actually deleted edges, and the edges added."""
    covered = materialize(groups.select("src", F.col("node_id").alias("dst")).distinct(), "covered")
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = covered.select(one.alias("e"), zero.alias("d"), zero.alias("a"))
    rows = rows.unionAll(edges.join(covered, ["src", "dst"], "left_semi").select(zero, one, zero))
    rows = rows.unionAll(groups.select("group_id").distinct().select(zero, zero, one))
    return rows.agg(F.sum("e").alias("expected_deleted"), F.sum("d").alias("actual_deleted"), F.sum("a").alias("added"))
