"""Sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.stats import neighbor_map


def with_shard(df: DataFrame, shards: int, by: str = "pos") -> DataFrame:
    """Stripe rows over shards: unit ``i`` goes to shard ``i mod shards``."""
    return df.withColumn("shard", F.pmod(F.col(by), F.lit(shards)).cast("int"))


def write_features(df: DataFrame, path: str, shards: int, by: str = "pos", mode: str = "errorifexists",
                   rows_per_file: int = 5_000_000) -> None:
    """Striped rows as one folder per shard, sorted by position inside each file."""
    (with_shard(df, shards, by)
     .repartition("shard", F.floor(F.col(by) / F.lit(rows_per_file * shards)))
     .sortWithinPartitions("shard", by)
     .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))


def write_trace(batches: DataFrame, path: str, epoch: int = 0) -> None:
    """Write one epoch's access trace; a job that is run again replaces its epoch."""
    batches.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def write_blocks(block_edges: DataFrame, path: str, epoch: int = 0) -> None:
    """Sampled neighbour lists per (epoch, layer, batch, dst); a job that is run again replaces its epoch."""
    neighbor_map(block_edges).write.mode("overwrite").partitionBy("layer").parquet(f"{path}/epoch={epoch}")


def block_nodes(block_edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(batch_id, layer, node_id, is_dst): the nodes a block reads, its destinations among them.

    ``seeds`` (batch_id, layer, node_id) adds destinations that got no edge.
    """
    keys = ["batch_id", "layer"]
    ends = [block_edges.select(*keys, F.col("src").alias("node_id"), F.lit(False).alias("is_dst")),
            block_edges.select(*keys, F.col("dst").alias("node_id"), F.lit(True).alias("is_dst"))]
    if seeds is not None:
        ends.append(seeds.select(*keys, "node_id", F.lit(True).alias("is_dst")))
    return reduce(DataFrame.unionByName, ends).groupBy(*keys, "node_id").agg(F.max("is_dst").alias("is_dst"))


def write_block_nodes(block_edges: DataFrame, path: str, epoch: int = 0, seeds: DataFrame | None = None) -> None:
    """Source and destination node sets per (epoch, layer, batch); a job that is run again replaces its epoch."""
    block_nodes(block_edges, seeds).write.mode("overwrite").partitionBy("layer").parquet(f"{path}/epoch={epoch}")


def export_dataset(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Labels, features and edges of a graph as three tables under ``path``."""
    nodes.select("node_id", "label").write.parquet(f"{path}/labels")
    nodes.select("node_id", "feat").write.parquet(f"{path}/features")
    edges.select("src", "dst").write.parquet(f"{path}/edges")


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "node_id", buckets: int = 64) -> None:
    """A bucketed table: joins on ``key`` with the same bucket count need no exchange."""
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
