"""Degrees, histograms, profiles and other aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.hashing import digest, hash_long
from nodeloom.plans.scan import chunked_lists, grouped_rank, hash_rank
from nodeloom.plans.store import materialize


def split_nodes(nodes: DataFrame, split: str) -> DataFrame:
    """Ids of one split."""
    return nodes.filter(F.col("split") == split).select("node_id")


def degrees(edges: DataFrame, nodes: DataFrame, direction: str = "in") -> DataFrame:
    """(node_id, degree) with zeros for nodes without edges; one partial aggregation, no join."""
    end = "dst" if direction == "in" else "src"
    ends = edges.select(F.col(end).alias("node_id"), F.lit(1).cast("bigint").alias("_c"))
    both = ends.unionByName(nodes.select("node_id", F.lit(0).cast("bigint").alias("_c")))
    return both.groupBy("node_id").agg(F.sum("_c").alias("degree"))


def out_degree_counts(edges: DataFrame) -> DataFrame:
    """(degree, n): how many sources have each out-degree."""
    per_src = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return per_src.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Edge count, sources with edges, and max / mean / median out-degree over them.

    The median is exact and taken over the degree histogram, which is far smaller than
    the set of sources.
    """
    return out_degree_counts(edges).agg(
        F.sum(F.col("degree") * F.col("n")).alias("total_edges"),
        F.sum("n").alias("unique_sources"),
        F.max("degree").alias("max_out_degree"),
        (F.sum(F.col("degree") * F.col("n")) / F.sum("n")).alias("avg_out_degree"),
        F.expr("percentile(degree, 0.5, n)").alias("median_out_degree"),
    )


def degree_histogram(edges: DataFrame) -> DataFrame:
    """(degree, n) for every degree from 0 to the largest, gaps filled with 0.

    Only the largest degree reaches the driver.
    """
    counts = materialize(out_degree_counts(edges), "hist")
    top = counts.agg(F.max("degree")).first()[0]
    dense = edges.sparkSession.range(0, (top if top is not None else 0) + 1).withColumnRenamed("id", "degree")
    return dense.join(counts, "degree", "left").select("degree", F.coalesce("n", F.lit(0)).alias("n"))


def low_degree_candidates(edges: DataFrame, nodes: DataFrame, below: int) -> DataFrame:
    """Nodes with in-degree under ``below``, zero included."""
    return degrees(edges, nodes, "in").filter(F.col("degree") < below)


def build_adjacency(edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Sorted neighbour lists (src, chunk, neighbors, n); a hub spans several chunks."""
    return chunked_lists(edges, ["src"], "dst", "dst", chunk=chunk, out="neighbors")


def in_neighborhoods(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, slot, member): the node itself at slot 0, then its in-neighbours by id."""
    rest = grouped_rank(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("member")), ["node_id"], "member", "_r")
    rest = rest.select("node_id", (F.col("_r") + 1).alias("slot"), "member")
    own = nodes.select("node_id", F.lit(0).cast("bigint").alias("slot"), F.col("node_id").alias("member"))
    return own.unionByName(rest)


def neighborhood_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, size): one for the node itself plus its in-degree."""
    return degrees(edges, nodes, "in").select("node_id", (F.col("degree") + 1).alias("size"))


def reduce_sum(arr: DataFrame, value: str = "v") -> DataFrame:
    """Total of a numeric column, with the number of elements."""
    return arr.agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def page_histogram(offsets: DataFrame, per_page: int, offset: str = "offset") -> DataFrame:
    """Vertices whose list starts in each page."""
    page = F.floor(F.col(offset) / F.lit(per_page)).cast("bigint")
    return offsets.groupBy(page.alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


def neighbor_map(block_edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Sampled neighbours per (batch, layer, dst) as sorted lists."""
    return chunked_lists(block_edges, ["batch_id", "layer", "dst"], "src", "src", chunk=chunk, out="neighbors")


def component_summary(comp: DataFrame) -> DataFrame:
    """(comp, size) of each component."""
    return comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def component_count(comp: DataFrame) -> DataFrame:
    sizes = component_summary(comp)
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"))


def storage_report(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slots used by the groups, nodes in none, total, and inflation over one slot per node."""
    tagged = groups.select("node_id", F.lit(1).alias("slot"), F.lit(0).alias("own"))
    tagged = tagged.unionByName(nodes.select("node_id", F.lit(0).alias("slot"), F.lit(1).alias("own")))
    per_node = tagged.groupBy("node_id").agg(F.sum("slot").alias("slots"), F.sum("own").alias("own"))
    totals = per_node.agg(
        F.sum("slots").alias("group_slots"),
        F.sum(F.when(F.col("slots") == 0, 1).otherwise(0)).alias("uncovered"),
        F.sum("own").alias("n_nodes"),
    )
    total = F.col("group_slots") + F.col("uncovered")
    return totals.select("group_slots", "uncovered", total.alias("total_slots"), (total / F.col("n_nodes")).alias("inflation"))


def accuracy(pred: DataFrame, predicted: str = "prediction", label: str = "label") -> DataFrame:
    """Percentage of equal labels over rows that have one."""
    hit = (F.col(predicted).cast("bigint") == F.col(label).cast("bigint")).cast("double")
    return pred.filter(F.col(label).isNotNull()).agg((F.avg(hit) * 100).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def label_profile(nodes: DataFrame, sample: int = 10) -> DataFrame:
    """Total, missing count and share, and the labels of the first ``sample`` labelled ids."""
    missing = F.col("label").isNull() | F.isnan(F.col("label").cast("double"))
    totals = nodes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(missing).alias("n_missing"),
        (F.count_if(missing) / F.count(F.lit(1))).alias("missing_share"),
    )
    head = nodes.filter(~missing).orderBy("node_id").limit(sample).select("node_id", "label")
    shown = head.agg(F.sort_array(F.collect_list(F.struct("node_id", "label"))).alias("_s"))
    shown = shown.select(F.transform("_s", lambda s: s["label"]).alias("sample"))
    both = totals.unionByName(shown, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in totals.columns], F.first("sample", ignorenulls=True).alias("sample"))


def synthesize_labels(nodes: DataFrame, fraction: float, classes: int, seed: int) -> DataFrame:
    """Exactly ``int(N * fraction)`` random nodes get a uniform class, the others none.

    The choice is by rank of a seeded digest, so no task sorts all of the chosen ids.
    """
    total = nodes.count()
    tagged = nodes.select("node_id", digest(seed, F.col("node_id")).alias("_h"))
    ranked = hash_rank(tagged, "_h", "node_id")
    label = F.when(
        F.col("rank") < int(total * fraction), hash_long(seed, "label", F.col("node_id")) % F.lit(classes)
    )
    return ranked.select("node_id", label.alias("label"))


def vector_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """c[i] = a[i] + b[i] for arrays as (i, v)."""
    return a.join(b.withColumnRenamed("v", "_b"), "i").select("i", (F.col("v") + F.col("_b")).alias("v"))
