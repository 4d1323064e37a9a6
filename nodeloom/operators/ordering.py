"""Sorts, top-k, processing order and mini-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.hashing import digest
from nodeloom.operators.stats import low_degree_candidates
from nodeloom.plans.scan import global_rank, hash_rank

SMALL_TOP = 10_000  # default of ``small``: up to here a per-partition heap and one final merge is cheapest


def sort_edges(edges: DataFrame) -> DataFrame:
    """Edges by source, then destination."""
    return edges.orderBy("src", "dst")


def top_nodes(scores: DataFrame, k: int | None = None, share: float | None = None,
              score: str = "score", small: int | None = None) -> DataFrame:
    """The first ``k`` nodes (or ``int(N * share)``) by descending score, ties by id, with rank.

    A k up to ``small`` is a heap per partition; a larger one is a distributed rank and a filter,
    as merging it would pull all winners through one task. Both give the same rows.
    """
    if k is None:
        k = int(scores.count() * share)
    order = [F.col(score).desc(), F.col("node_id").asc()]
    if k <= (SMALL_TOP if small is None else small):
        scores = scores.orderBy(*order).limit(k)
    return global_rank(scores, order).filter(F.col("rank") < k)


def top_low_degree(edges: DataFrame, nodes: DataFrame, below: int, k: int) -> DataFrame:
    """The ``k`` largest in-degrees among nodes under the threshold."""
    low = low_degree_candidates(edges, nodes, below)
    return top_nodes(low, k=k, score="degree")


def processing_order(nodes: DataFrame, mode: str = "degree_asc") -> DataFrame:
    """Global position of (node_id, degree, score): by degree (``degree_asc`` or
    ``degree_desc``), then descending score, then id."""
    first = F.col("degree").asc() if mode == "degree_asc" else F.col("degree").desc()
    return global_rank(nodes, [first, F.col("score").desc(), F.col("node_id").asc()])


def make_batches(ids: DataFrame, size: int, seed: int = 0, epoch: int = 0, *,
                 shuffle: bool = True, drop_last: bool = False) -> DataFrame:
    """(batch_id, pos, node_id): a seeded order cut into consecutive slices."""
    if shuffle:
        tagged = ids.select("node_id", digest(seed, epoch, F.col("node_id")).alias("_h"))
        ranked = hash_rank(tagged, "_h", "node_id")
    else:
        ranked = global_rank(ids.select("node_id"), [F.col("node_id")])
    batch = F.floor(F.col("rank") / F.lit(size)).cast("bigint")
    if drop_last:
        ranked = ranked.filter(batch < F.lit(ids.count() // size))
    return ranked.select(batch.alias("batch_id"), (F.col("rank") % F.lit(size)).alias("pos"), "node_id")
