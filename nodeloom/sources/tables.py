"""Table schemas and Parquet-backed graph tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.plans.scan import prefix_scan
from nodeloom.plans.skew import shuffled

_LONG = T.LongType()
CHUNK = 1 << 16

EDGES = T.StructType([T.StructField("src", _LONG), T.StructField("dst", _LONG)])
FEATURES = T.StructType([T.StructField("node_id", _LONG), T.StructField("feat", T.ArrayType(T.FloatType()))])
TRACE = T.StructType([T.StructField(n, _LONG) for n in ("batch_id", "pos", "node_id")])
LAYOUT = T.StructType([T.StructField("pos", _LONG), T.StructField("node_id", _LONG)])


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Edge list as (src, dst): Parquet, an array file (``npy``) or binary CSR (``csr``).

    Array files may be 2 x E or E x k; only the first two columns count.
    """
    if fmt == "parquet":
        table = spark.read.parquet(path)
        first, second = table.columns[:2]
        return table.select(F.col(first).cast("bigint").alias("src"), F.col(second).cast("bigint").alias("dst"))
    from nodeloom.sources import arrays

    if fmt == "npy":
        return arrays.read_npy_edges(spark, path)
    if fmt == "csr":
        return arrays.read_csr(spark, path)
    raise ValueError(f"unknown edge format {fmt!r}")


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature matrix as (node_id, feat); the row ordinal is the id for array files."""
    if fmt == "parquet":
        return spark.read.schema(FEATURES).parquet(path)
    if fmt == "npy":
        from nodeloom.sources import arrays

        return arrays.read_npy(spark, path).select(
            F.col("row").alias("node_id"), F.col("vals").cast("array<float>").alias("feat")
        )
    raise ValueError(f"unknown feature format {fmt!r}")


def read_hetero(
    nodes: Mapping[str, DataFrame], edges: Mapping[tuple[str, str, str], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Typed tables to one node table (ntype, node_id) and one edge table
    (etype, src_type, src, dst_type, dst)."""
    typed_nodes = [df.select(F.lit(t).alias("ntype"), F.col(df.columns[0]).cast("bigint").alias("node_id"))
                   for t, df in nodes.items()]
    typed_edges = [
        df.select(F.lit(e).alias("etype"), F.lit(s).alias("src_type"), F.col(df.columns[0]).cast("bigint").alias("src"),
                  F.lit(d).alias("dst_type"), F.col(df.columns[1]).cast("bigint").alias("dst"))
        for (s, e, d), df in edges.items()
    ]
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(typed_nodes), union(typed_edges)


def type_offsets(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(ntype, key_off, size): each type's start in one global row space, by ``order``.

    One row per type, a number fixed by the schema.
    """
    rank = F.create_map(*[x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i))])
    sizes = nodes.groupBy("ntype").agg((F.max("node_id") + 1).alias("size"))
    sizes = sizes.withColumn("_i", rank[F.col("ntype")].cast("bigint"))
    return prefix_scan(sizes, "_i", "size", "key_off", inclusive=False).select(
        "ntype", F.col("key_off").cast("bigint").alias("key_off"), "size"
    )


def read_trace(ids: DataFrame, lengths: DataFrame) -> DataFrame:
    """(ord, node_id) and (batch_id, size) to (batch_id, pos, node_id).

    Batch starts are the exclusive running total of sizes. Batches are cut into chunks of at
    most ``CHUNK`` ordinals and each chunk lists its own, so the join key is the ordinal itself:
    unique on both sides however long or short the batches are. There are as many ordinals as
    ids, whatever Spark makes of the size of the few lengths, so they are not broadcast.
    """
    starts = prefix_scan(lengths, "batch_id", "size", "start", inclusive=False).filter(F.col("size") > 0)
    stop = F.col("start") + F.col("size")
    chunks = F.sequence(F.floor(F.col("start") / CHUNK), F.floor((stop - 1) / CHUNK))
    cut = starts.withColumn("_c", F.explode(chunks))
    first, last = F.greatest("start", F.col("_c") * CHUNK), F.least(stop, (F.col("_c") + 1) * CHUNK) - 1
    places = cut.select("batch_id", "start", F.explode(F.sequence(first, last)).alias("ord"))
    placed = ids.join(shuffled(places), "ord")
    return placed.select("batch_id", (F.col("ord") - F.col("start")).cast("bigint").alias("pos"), "node_id")


def read_slice(features: DataFrame, offset: int, num: int, by: str = "node_id") -> DataFrame:
    """``num`` rows from position ``offset``, in order; the range reaches the scan as a filter."""
    return features.filter(F.col(by).between(offset, offset + num - 1)).orderBy(by)
