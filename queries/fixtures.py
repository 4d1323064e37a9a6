"""Graph tables derived from the given Parquet tables, as DataFrames and as SQL.

A derived table is written once per session and folder and read from there by every query,
as a prepared dataset would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.plans.store import materialize
from nodeloom.sources.tables import read_hetero

NODE_TYPES = ["customer", "orders", "part", "supplier"]
PER_BATCH = 50  # orders per mini-batch of the access trace
BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    BUILDERS[fn.__name__] = fn

    def load(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialize(fn(spark, sf), fn.__name__)
        return _WRITTEN[key]

    load.__name__ = fn.__name__
    return load


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    a = items.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"),
                     "l_quantity", "l_discount")
    b = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("src <> dst")


@fixture
def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts bought one after another in an order."""
    return _pairs(spark, sf).select("src", "dst").distinct()


@fixture
def edges_w(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy("src", "dst").agg(
        F.floor(F.min("l_quantity")).cast("bigint").alias("w"), (F.min("l_discount") + F.lit(0.01)).alias("wf")
    )


@fixture
def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a feature vector, labels with gaps, and a split."""
    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(key, (key % F.lit(n)).alias("vec_id"))
    split = F.when(key % 10 < 6, "train").when(key % 10 < 8, "val").otherwise("test")
    return parts.join(vectors, "vec_id").select(
        key.alias("node_id"), F.col("embedding").alias("feat"),
        F.when(key % 100 != 7, F.col("label")).alias("label"), split.alias("split"),
    )


@fixture
def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses of mini-batches of orders; a batch is a bounded group of orders."""
    items = table(spark, sf, "lineitem")
    batch = F.floor(F.col("l_orderkey") / F.lit(PER_BATCH)).cast("bigint")
    window = W.partitionBy("batch_id").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    rows = items.select(batch.alias("batch_id"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("batch_id", (F.row_number().over(window) - 1).cast("bigint").alias("pos"), F.col("l_partkey").alias("node_id"))


def _typed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf, name)
    node_tables = {
        "customer": t("customer").select("c_custkey"), "orders": t("orders").select("o_orderkey"),
        "part": t("part").select("p_partkey"), "supplier": t("supplier").select("s_suppkey"),
    }
    items = t("lineitem")
    edge_tables = {
        ("customer", "placed", "orders"): t("orders").select("o_custkey", "o_orderkey"),
        ("orders", "contains", "part"): items.select("l_orderkey", "l_partkey").distinct(),
        ("part", "supplied_by", "supplier"): items.select("l_partkey", "l_suppkey").distinct(),
    }
    return read_hetero(node_tables, edge_tables)


@fixture
def typed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf)[0]


@fixture
def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf)[1]


@fixture
def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their orders in one id space: even ids are orders, odd ids customers."""
    return table(spark, sf, "orders").select((F.col("o_custkey") * 2 + 1).alias("src"), (F.col("o_orderkey") * 2).alias("dst"))


@fixture
def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id, score): price of the part in cents, a stand-in for an importance score."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), F.floor(F.col("p_retailprice") * 100).cast("double").alias("score"))


@fixture
def typed_features(spark: SparkSession, sf: str) -> DataFrame:
    """(node_id = global row, feat) for all typed nodes."""
    from nodeloom.operators.gather import encode_type_offset
    from nodeloom.sources.tables import type_offsets

    vectors = table(spark, sf, "embeddings")
    n = vectors.count()
    all_nodes = typed_nodes(spark, sf)
    rows = encode_type_offset(all_nodes, type_offsets(all_nodes, NODE_TYPES))
    rows = rows.select(F.col("row_id").alias("node_id"), (F.col("row_id") % F.lit(n)).alias("vec_id"))
    return rows.join(vectors, "vec_id").select("node_id", F.col("embedding").alias("feat"))


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"))


def arr(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("v"))


def arr_price(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("i"), F.floor("o_totalprice").cast("bigint").alias("v"))


def typed_index(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_id, ntype, node_id): parts and suppliers each mini-batch touches."""
    items = table(spark, sf, "lineitem").withColumn("batch_id", F.floor(F.col("l_orderkey") / F.lit(PER_BATCH)).cast("bigint"))
    parts = items.select("batch_id", F.lit("part").alias("ntype"), F.col("l_partkey").alias("node_id"))
    return parts.unionByName(items.select("batch_id", F.lit("supplier").alias("ntype"), F.col("l_suppkey").alias("node_id")))


# The same tables in SQL ---------------------------------------------------------

CTE = {
    "edges": (
        "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b "
        "ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey"
    ),
    "edges_w": (
        "SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(floor(min(a.l_quantity)) AS BIGINT) AS w, "
        "min(a.l_discount) + 0.01::DOUBLE AS wf FROM lineitem a JOIN lineitem b "
        "ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey "
        "GROUP BY a.l_partkey, b.l_partkey"
    ),
    "ids": "SELECT p_partkey AS node_id FROM part",
    "nodes": (
        "SELECT p_partkey AS node_id, embedding AS feat, CASE WHEN p_partkey % 100 = 7 THEN NULL ELSE label END AS label, "
        "CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'val' ELSE 'test' END AS split "
        "FROM part JOIN embeddings ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id"
    ),
    "trace": (
        "SELECT l_orderkey // 50 AS batch_id, row_number() OVER (PARTITION BY l_orderkey // 50 "
        "ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos, l_partkey AS node_id FROM lineitem"
    ),
    "typed_nodes": (
        "SELECT 'customer' AS ntype, c_custkey AS node_id FROM customer UNION ALL SELECT 'orders', o_orderkey FROM orders "
        "UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier"
    ),
    "typed_edges": (
        "SELECT 'placed' AS etype, 'customer' AS src_type, o_custkey AS src, 'orders' AS dst_type, o_orderkey AS dst FROM orders "
        "UNION ALL SELECT DISTINCT 'contains', 'orders', l_orderkey, 'part', l_partkey FROM lineitem "
        "UNION ALL SELECT DISTINCT 'supplied_by', 'part', l_partkey, 'supplier', l_suppkey FROM lineitem"
    ),
    "type_sizes": (
        "SELECT ntype, max(node_id) + 1 AS size, CASE ntype WHEN 'customer' THEN 0 WHEN 'orders' THEN 1 "
        "WHEN 'part' THEN 2 ELSE 3 END AS i FROM typed_nodes GROUP BY ntype"
    ),
    "offsets": (
        "SELECT ntype, CAST(coalesce(sum(size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
        "AS key_off, size FROM type_sizes"
    ),
    "typed_features": (
        "SELECT n.node_id + o.key_off AS node_id, e.embedding AS feat FROM typed_nodes n JOIN offsets o USING (ntype) "
        "JOIN embeddings e ON (n.node_id + o.key_off) % (SELECT count(*) FROM embeddings) = e.vec_id"
    ),
    "typed_index": (
        "SELECT l_orderkey // 50 AS batch_id, 'part' AS ntype, l_partkey AS node_id FROM lineitem "
        "UNION ALL SELECT l_orderkey // 50, 'supplier', l_suppkey FROM lineitem"
    ),
    "order_edges": "SELECT o_custkey * 2 + 1 AS src, o_orderkey * 2 AS dst FROM orders",
    "scores": "SELECT p_partkey AS node_id, CAST(floor(p_retailprice * 100) AS DOUBLE) AS score FROM part",
    "arr": "SELECT o_orderkey AS i, o_custkey AS v FROM orders",
    "arr_price": "SELECT o_orderkey AS i, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders",
    "in_deg": (
        "SELECT i.node_id, count(e.src) AS degree FROM ids i LEFT JOIN edges e ON e.dst = i.node_id GROUP BY i.node_id"
    ),
    "out_deg": (
        "SELECT i.node_id, count(e.dst) AS degree FROM ids i LEFT JOIN edges e ON e.src = i.node_id GROUP BY i.node_id"
    ),
    "visits": "SELECT DISTINCT batch_id, node_id FROM trace",
}
NEEDS = {
    "type_sizes": ["typed_nodes"], "offsets": ["type_sizes"], "typed_features": ["offsets"],
    "in_deg": ["ids", "edges"], "out_deg": ["ids", "edges"], "visits": ["trace"],
}


def sql(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """``body`` with the named fixture CTEs, and ``extra`` CTEs after them in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in order]
    parts += [text if text.startswith("@") else f"{n} AS MATERIALIZED ({text})" for n, text in extra.items()]
    parts = [p[1:] if p.startswith("@") else p for p in parts]
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " if parts else ""
    return head + body


# Comparable forms of vectors ----------------------------------------------------


def feat_digest(col: str = "feat") -> Column:
    """md5 over all entries in whole millionths."""
    return F.md5(F.array_join(F.transform(col, lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ","))


def feat_digest_sql(col: str = "feat") -> str:
    return (f"md5(array_to_string(list_transform({col}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)::VARCHAR), ','))")


def vector_text(col: str) -> Column:
    """All entries in ten-thousandths, rounded, joined by commas."""
    return F.array_join(F.transform(col, lambda x: F.round(x * 10000).cast("bigint").cast("string")), ",")


VECTOR_TEXT_SQL = "string_agg(CAST(round(x * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY dim)"
