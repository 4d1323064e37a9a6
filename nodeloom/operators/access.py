"""Access-trace analytics: frequency, reuse, lookahead and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.operators.gather import remap_ids
from nodeloom.plans.store import Saved, save


def _visits(trace: DataFrame) -> DataFrame:
    return trace.select("batch_id", "node_id").distinct()


def access_frequency(trace: DataFrame) -> DataFrame:
    """Number of batches each node occurs in."""
    return _visits(trace).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_batches"))


def lookahead_reuse(trace: DataFrame, ahead: int, block: int = 4096) -> DataFrame:
    """Per (batch, node): in how many of the next ``ahead`` batches the node is used again.

    A node used in every batch would be one huge window group, so each node's visits are cut
    into blocks of batches; the first ``ahead`` batches of a block are also lent to the block
    before it.
    """
    block = max(block, ahead)
    visits = _visits(trace).withColumn("_blk", F.floor(F.col("batch_id") / F.lit(block)).cast("bigint"))
    lend = (F.col("batch_id") - F.col("_blk") * block) < ahead
    homes = F.when(lend, F.array(F.col("_blk"), F.col("_blk") - 1)).otherwise(F.array(F.col("_blk")))
    placed = visits.withColumn("_home", F.explode(homes))
    window = W.partitionBy("node_id", "_home").orderBy("batch_id").rangeBetween(1, ahead)
    counted = placed.withColumn("reuses", F.count(F.lit(1)).over(window))
    return counted.filter("_home = _blk").select("batch_id", "node_id", "reuses")


def reuse_gap(trace: DataFrame, block: int = 4096) -> DataFrame:
    """Batches since the node's previous use, NULL at the first use.

    Inside a block of batches by ``lag``; across blocks from the last use of the closest
    earlier block, one row per (node, block).
    """
    visits = _visits(trace).withColumn("_blk", F.floor(F.col("batch_id") / F.lit(block)).cast("bigint"))
    ends = visits.groupBy("node_id", "_blk").agg(F.max("batch_id").alias("_last"))
    carry = ends.select(
        "node_id", "_blk", F.lag("_last").over(W.partitionBy("node_id").orderBy("_blk")).alias("_carry")
    )
    inner = visits.withColumn(
        "_prev", F.lag("batch_id").over(W.partitionBy("node_id", "_blk").orderBy("batch_id"))
    )
    joined = inner.join(carry, ["node_id", "_blk"])
    gap = F.col("batch_id") - F.coalesce("_prev", "_carry")
    return joined.select("batch_id", "node_id", gap.alias("gap"))


def cold_share(trace: DataFrame) -> DataFrame:
    """Share of first uses per batch."""
    gaps = reuse_gap(trace)
    cold = F.count_if(F.col("gap").isNull())
    return gaps.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("nodes"), cold.alias("cold"), (cold / F.count(F.lit(1))).alias("cold_share")
    )


def prefetch_intersection(trace: DataFrame, ahead: int) -> DataFrame:
    """Per batch, its nodes that recur in the next ``ahead`` batches."""
    return lookahead_reuse(trace, ahead).filter("reuses > 0").select("batch_id", "node_id")


def attach_page(layout: DataFrame, nodes_per_page: int, pos: str = "pos") -> DataFrame:
    """page_id = floor(position / nodes per page)."""
    return layout.withColumn("page_id", F.floor(F.col(pos) / F.lit(nodes_per_page)).cast("bigint"))


def batch_counts(trace: DataFrame, nodes_per_page: int) -> DataFrame:
    """Accesses, distinct nodes and distinct pages per batch."""
    paged = attach_page(trace, nodes_per_page, "node_id")
    return paged.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("accesses"),
        F.count_distinct("node_id").alias("nodes"),
        F.count_distinct("page_id").alias("pages"),
    )


def pages_raw(trace: DataFrame, nodes_per_page: int) -> DataFrame:
    """(batch_id, page_id, first_pos): distinct pages of the id order, by first use."""
    paged = attach_page(trace, nodes_per_page, "node_id")
    return paged.groupBy("batch_id", "page_id").agg(F.min("pos").alias("first_pos"))


def pages_reorganized(trace: DataFrame, layout: DataFrame, nodes_per_page: int, dedupe: bool = False) -> DataFrame:
    """One page per access through a layout; ``dedupe`` reads a page once per batch."""
    paged = attach_page(remap_ids(trace, layout), nodes_per_page, "slot")
    if dedupe:
        return paged.groupBy("batch_id", "page_id").agg(F.min("pos").alias("first_pos"))
    return paged.select("batch_id", "page_id", F.col("pos").alias("first_pos"))


def pages_neighbor(trace: DataFrame, layout: DataFrame, nodes_per_page: int) -> DataFrame:
    """(batch_id, page_id, first_pos): pages read when a batch is scanned in order and a node
    already brought in by an earlier page is skipped.

    ``layout`` is (node_id, slot, member, pos): each node's own entry (slot 0) followed by its
    neighbours. Whether a node's page is read depends on earlier nodes of its batch only, so
    the scan becomes rounds: a node is skipped once an earlier reader's page holds it, and
    reads its page once every earlier node whose page holds it has been skipped. Each node
    brings in at most ``nodes_per_page`` others, which bounds the dependency table.
    """
    own = layout.filter("slot = 0").select("node_id", "pos")
    paged = attach_page(layout, nodes_per_page).select("page_id", F.col("member").alias("node_id")).distinct()
    first = trace.groupBy("batch_id", "node_id").agg(F.min("pos").alias("first_pos"))
    nodes = save(first.join(attach_page(own, nodes_per_page).select("node_id", "page_id"), "node_id"), "scan")
    ahead = nodes.df.select("batch_id", "page_id", F.col("node_id").alias("u"), F.col("first_pos").alias("_at"))
    later = nodes.df.select("batch_id", "node_id", "first_pos")
    needs = ahead.join(paged, "page_id").join(later, ["batch_id", "node_id"])
    needs = needs.filter(F.col("_at") < F.col("first_pos")).select("batch_id", "u", "node_id")
    needs = save(needs, "needs")
    open_nodes = save(nodes.df.select("batch_id", "node_id"), "open")
    read: list[Saved] = []
    trash = [open_nodes, needs]
    while open_nodes.rows:
        # Readers: open nodes with no undecided or reading predecessor left.
        blocked = needs.df.select("batch_id", "node_id").distinct()
        ready = save(open_nodes.df.join(blocked, ["batch_id", "node_id"], "left_anti"), "read")
        read.append(ready)
        sources = ready.df.select("batch_id", F.col("node_id").alias("u"))
        skipped = save(needs.df.join(sources, ["batch_id", "u"], "left_semi").select("batch_id", "node_id").distinct(), "skip")
        done = ready.df.unionByName(skipped.df)
        open_nodes = save(open_nodes.df.join(done, ["batch_id", "node_id"], "left_anti"), "open")
        gone = done.select("batch_id", F.col("node_id").alias("u"))
        needs = save(
            needs.df.join(gone, ["batch_id", "u"], "left_anti")
            .join(skipped.df, ["batch_id", "node_id"], "left_anti").select("batch_id", "u", "node_id"), "needs")
        for old in trash:
            old.drop()
        trash = [open_nodes, needs, skipped]
    result = read[0].df if read else open_nodes.df
    for part in read[1:]:
        result = result.unionByName(part.df)
    return result.join(nodes.df, ["batch_id", "node_id"]).select("batch_id", "page_id", "first_pos")


def dataset_volume(trace: DataFrame, pages: DataFrame, row_bytes: int, page_bytes: int) -> DataFrame:
    """Bytes asked for, bytes moved as whole pages, and their ratio."""
    kinds = trace.select(F.lit(1).alias("r"), F.lit(0).alias("p")).unionAll(pages.select(F.lit(0), F.lit(1)))
    totals = kinds.agg(F.sum("r").alias("rows_requested"), F.sum("p").alias("pages_moved"))
    asked, moved = F.col("rows_requested") * row_bytes, F.col("pages_moved") * page_bytes
    return totals.select(
        "rows_requested", "pages_moved", asked.alias("bytes_requested"), moved.alias("bytes_moved"),
        (moved / asked).alias("amplification"),
    )


def layout_report(trace: DataFrame, pages: dict[str, DataFrame], row_bytes: int, page_bytes: int) -> DataFrame:
    """One :func:`dataset_volume` row per named layout."""
    rows = [dataset_volume(trace, p, row_bytes, page_bytes).withColumn("layout", F.lit(name)) for name, p in pages.items()]
    report = rows[0]
    for row in rows[1:]:
        report = report.unionByName(row)
    return report
