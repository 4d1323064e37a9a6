"""Fetching feature rows for node lists: plain, typed, batched and tiered.

A gather is a join that keeps order and duplicates of the index. A node that many
batches ask for is a hot key on the index side, which Spark's skew join splits; the wide
feature column appears in no other plan step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators.ordering import top_nodes
from nodeloom.plans.store import materialize

_FOUND = "_found"


def _found(df: DataFrame, key: str = "node_id") -> DataFrame:
    """``df`` with the marker :func:`require` looks for after a left join."""
    return df.withColumn(_FOUND, F.col(key))


def require(df: DataFrame, what: str, key: str = "node_id") -> DataFrame:
    """Fail the job when an index entry found no row.

    The check is a filter on the marker, so it runs whichever columns are read afterwards.
    """
    error = F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return df.filter(F.when(F.col(_FOUND).isNull(), error).otherwise(F.lit(True))).drop(_FOUND)


def gather_features(index: DataFrame, features: DataFrame, key_off: int = 0) -> DataFrame:
    """feat[index + key_off] for every index row; a missing row is an error."""
    if key_off:
        features = features.withColumn("node_id", F.col("node_id") - F.lit(key_off))
    return require(index.join(_found(features.select("node_id", "feat")), "node_id", "left"), "feature row")


def encode_type_offset(ids: DataFrame, offsets: DataFrame) -> DataFrame:
    """Global row of (ntype, node_id); an unknown type is an error."""
    joined = ids.join(F.broadcast(offsets.select("ntype", "key_off")), "ntype", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown node type "), F.col("ntype")))
    row = F.col("node_id") + F.coalesce("key_off", unknown)
    return joined.withColumn("row_id", row).drop("key_off")


def decode_type_offset(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Back from a global row to (ntype, node_id). The offsets, one row per node type of the
    schema, become a CASE expression, so there is no range join."""
    ntype, start = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for o in offsets.collect():
        inside = F.col("row_id").between(o.key_off, o.key_off + o.size - 1)
        ntype, start = F.when(inside, o.ntype).otherwise(ntype), F.when(inside, o.key_off).otherwise(start)
    return rows.withColumn("ntype", ntype).withColumn("node_id", F.col("row_id") - start)


def gather_features_hetero(index: DataFrame, features: DataFrame, offsets: DataFrame) -> DataFrame:
    """Typed ids against one global feature table (node_id = global row)."""
    rows = encode_type_offset(index, offsets)
    wide = features.select(F.col("node_id").alias("row_id"), "feat")
    return require(rows.join(_found(wide, "row_id"), "row_id", "left"), "feature row", "row_id")


def gather_batches(batches: DataFrame, features: DataFrame) -> DataFrame:
    """Many mini-batches in one pass. The wide side is first cut to the distinct ids some batch
    asks for and written; both sides of the join are then shuffled for it alone, so that a
    node which is in every batch can be split."""
    wanted = batches.select("node_id").distinct()
    needed = materialize(features.select("node_id", "feat").join(wanted, "node_id", "left_semi"), "needed")
    return require(batches.join(_found(needed), "node_id", "left"), "feature row")


def pin_features(features: DataFrame, ranking: DataFrame, share: float) -> DataFrame:
    """Rows of the first ``int(N * share)`` ranked nodes."""
    hot = top_nodes(ranking, share=share)
    return features.select("node_id", "feat").join(hot.select("node_id"), "node_id")


def tag_tier(index: DataFrame, pinned: DataFrame) -> DataFrame:
    """Which tier serves each index row: ``pinned`` or ``storage``.

    Spark broadcasts the pinned ids while their measured bytes are below its threshold.
    """
    ids = pinned.select("node_id", F.lit("pinned").alias("tier"))
    return index.join(ids, "node_id", "left").withColumn("tier", F.coalesce("tier", F.lit("storage")))


def gather_tiered(index: DataFrame, features: DataFrame, pinned: DataFrame) -> DataFrame:
    """Same rows as a plain gather plus the serving tier.

    ``pinned`` is (node_id, feat). The index is evaluated once: its narrow rows are written with their
    tier. Rows of pinned nodes take their vector from ``pinned``, by broadcast while Spark measures it
    below its threshold; the others take the shuffle join, which thereby loses its hottest keys.
    """
    tagged = materialize(tag_tier(index, pinned), "tagged")
    near = tagged.filter(F.col("tier") == "pinned").join(pinned.select("node_id", "feat"), "node_id")
    far = tagged.filter(F.col("tier") == "storage")
    far = require(far.join(_found(features.select("node_id", "feat")), "node_id", "left"), "feature row")
    return near.unionByName(far.select(*near.columns))


def remap_ids(index: DataFrame, layout: DataFrame) -> DataFrame:
    """Position of every index row in a layout; a replicated node maps to its first slot."""
    first = materialize(layout.groupBy("node_id").agg(F.min("pos").alias("slot")), "slots")
    return require(index.join(_found(first), "node_id", "left"), "layout slot")


def block_to_global(block_edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame) -> DataFrame:
    """(batch_id, layer, u, v) local ids to global (src, dst)."""
    key = ["batch_id", "layer"]
    src = src_nodes.select(*key, F.col("local_id").alias("u"), F.col("node_id").alias("src"))
    dst = dst_nodes.select(*key, F.col("local_id").alias("v"), F.col("node_id").alias("dst"))
    return block_edges.join(src, [*key, "u"]).join(dst, [*key, "v"]).select(*key, "src", "dst")


def tier_stats(tagged: DataFrame) -> DataFrame:
    """Accesses per batch and tier with the hit ratio; the NULL batch is the total."""
    hit = F.count_if(F.col("tier") == "pinned")
    return tagged.rollup("batch_id").agg(
        F.count(F.lit(1)).alias("accesses"),
        hit.alias("pinned"),
        F.count_if(F.col("tier") == "storage").alias("storage"),
        (hit / F.count(F.lit(1))).alias("hit_ratio"),
    )


def cached_features(features: DataFrame) -> DataFrame:
    """A written copy of a pinned table, read by every later gather."""
    return materialize(features, "pinned")
