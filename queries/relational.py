"""Sources, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import access, gather, ordering, sampling, sets, stats
from nodeloom.plans import scan
from nodeloom.plans.store import fresh_path, materialize
from nodeloom.sources import arrays, tables, writers
from queries import fixtures as fx
from queries.fixtures import feat_digest, feat_digest_sql, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return register


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in cols])


# Sources and sinks --------------------------------------------------------------


@query(sql("SELECT src, dst FROM edges", "edges"))
def read_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge list written as array shards and read back by row ranges."""
    path = fresh_path(spark, "edges-npy")
    arrays.write_npy(fx.edges(spark, sf), path)
    return tables.read_edges(spark, path, "npy")


@query(sql("SELECT src, dst FROM edges", "edges"))
def read_csr(spark, sf):
    """The edge list written as shards of binary CSR and read back by ranges of edges."""
    path = fresh_path(spark, "edges-csr")
    arrays.write_csr(fx.edges(spark, sf), path)
    return tables.read_edges(spark, path, "csr")


@query(sql("SELECT src, dst FROM edges WHERE src BETWEEN (SELECT min(src) + (max(src) - min(src)) // 3 FROM edges) "
           "AND (SELECT min(src) + (max(src) - min(src)) // 2 FROM edges)", "edges"))
def read_csr_range(spark, sf):
    """The neighbour lists of a range of vertices: the range picks shards and offsets."""
    path = fresh_path(spark, "edges-csr")
    arrays.write_csr(fx.edges(spark, sf), path)
    ends = fx.edges(spark, sf).agg(F.min("src").alias("a"), F.max("src").alias("b")).first()
    a, b = ends["a"], ends["b"]
    return tables.read_edges(spark, path, "csr").filter(F.col("src").between(a + (b - a) // 3, a + (b - a) // 2))


@query(sql(f"SELECT node_id, {feat_digest_sql()} AS feat_md5 FROM nodes", "nodes"))
def read_features(spark, sf):
    path = fresh_path(spark, "feat-npy")
    arrays.write_npy(fx.nodes(spark, sf).select("node_id", "feat"), path, "<f4", order="node_id")
    return tables.read_features(spark, path, "npy").select("node_id", feat_digest().alias("feat_md5"))


@query(sql("SELECT etype, src_type, dst_type, count(*) AS n, CAST(sum(src) AS BIGINT) AS sum_src, CAST(sum(dst) AS BIGINT) AS sum_dst "
           "FROM typed_edges GROUP BY 1, 2, 3", "typed_edges"))
def read_hetero(spark, sf):
    return fx.typed_edges(spark, sf).groupBy("etype", "src_type", "dst_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("src").alias("sum_src"), F.sum("dst").alias("sum_dst"))


@query(sql("SELECT ntype, key_off, size FROM offsets", "offsets"))
def type_offsets(spark, sf):
    return _typed_offsets(spark, sf).select("ntype", "key_off", "size")


def _typed_offsets(spark, sf):
    return tables.type_offsets(fx.typed_nodes(spark, sf), fx.NODE_TYPES)


@query(sql("SELECT batch_id, pos, node_id FROM trace", "trace"))
def read_trace(spark, sf):
    """Concatenated ids plus lengths, back to (batch, pos, node)."""
    trace = fx.trace(spark, sf)
    sizes = trace.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
    starts = scan.prefix_scan(sizes, "batch_id", "size", "start", inclusive=False).select("batch_id", "start")
    flat = trace.join(starts, "batch_id").select((F.col("start") + F.col("pos")).alias("ord"), "node_id")
    return tables.read_trace(materialize(flat, "flat"), materialize(sizes, "sizes"))


@query(sql("SELECT CAST(node_id % 8 AS BIGINT) AS shard, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS pos_sum FROM nodes GROUP BY 1", "nodes"))
def write_features(spark, sf):
    """Rows striped over 8 shards, read back per shard."""
    path = fresh_path(spark, "striped")
    writers.write_features(fx.nodes(spark, sf).select("node_id", "feat"), path, 8, by="node_id")
    return spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("node_id").alias("pos_sum"))


@query(sql("SELECT batch_id, pos, node_id, e.epoch FROM trace, (SELECT unnest([0, 1])::BIGINT AS epoch) e", "trace"))
def write_trace(spark, sf):
    """Two epochs appended to one trace table."""
    path = fresh_path(spark, "trace")
    for epoch in (0, 1):
        writers.write_trace(fx.trace(spark, sf), path, epoch)
    return spark.read.parquet(path).select("batch_id", "pos", "node_id", F.col("epoch").cast("bigint").alias("epoch"))


@query(sql("SELECT 0::BIGINT AS epoch, 0::BIGINT AS layer, src % 4 AS batch_id, dst, string_agg(src::VARCHAR, ',' ORDER BY src) AS neighbors "
           "FROM edges GROUP BY src % 4, dst", "edges"))
def write_blocks(spark, sf):
    """Neighbour maps of four blocks that share out all edges by source."""
    path = fresh_path(spark, "blocks")
    blocks = fx.edges(spark, sf).select((F.col("src") % 4).alias("batch_id"), F.lit(0).cast("bigint").alias("layer"), "src", "dst")
    writers.write_blocks(blocks, path)
    back = spark.read.parquet(path)
    return back.select(F.col("epoch").cast("bigint").alias("epoch"), F.col("layer").cast("bigint").alias("layer"), "batch_id", "dst",
                       F.array_join("neighbors", ",").alias("neighbors"))


@query(sql("SELECT 0::BIGINT AS epoch, 0::BIGINT AS layer, batch_id, node_id, bool_or(is_dst) AS is_dst FROM ("
           "SELECT src % 4 AS batch_id, src AS node_id, false AS is_dst FROM edges UNION ALL SELECT src % 4, dst, true FROM edges) "
           "GROUP BY batch_id, node_id", "edges"))
def write_block_nodes(spark, sf):
    """Node sets of four blocks that share out all edges by source."""
    path = fresh_path(spark, "block-nodes")
    blocks = fx.edges(spark, sf).select((F.col("src") % 4).alias("batch_id"), F.lit(0).cast("bigint").alias("layer"), "src", "dst")
    writers.write_block_nodes(blocks, path)
    return spark.read.parquet(path).select(F.col("epoch").cast("bigint").alias("epoch"), F.col("layer").cast("bigint").alias("layer"),
                                           "batch_id", "node_id", "is_dst")


@query(sql("SELECT 'labels' AS part, (SELECT count(*) FROM nodes) AS n, (SELECT CAST(sum(label) AS BIGINT) FROM nodes) AS total "
           "UNION ALL SELECT 'features', (SELECT count(*) FROM nodes), (SELECT CAST(sum(len(feat)) AS BIGINT) FROM nodes) "
           "UNION ALL SELECT 'edges', (SELECT count(*) FROM edges), (SELECT CAST(sum(src + dst) AS BIGINT) FROM edges)", "nodes", "edges"))
def export_dataset(spark, sf):
    path = fresh_path(spark, "export")
    writers.export_dataset(fx.nodes(spark, sf), fx.edges(spark, sf), path)
    what = {"labels": F.col("label"), "features": F.size("feat"), "edges": F.col("src") + F.col("dst")}
    parts = [spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"),
                                                  F.sum(v).cast("bigint").alias("total")) for p, v in what.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql(f"SELECT node_id, {feat_digest_sql()} AS feat_md5 FROM nodes WHERE node_id BETWEEN 40 AND 139", "nodes"))
def read_slice(spark, sf):
    return tables.read_slice(fx.nodes(spark, sf).select("node_id", "feat"), 40, 100).select("node_id", feat_digest().alias("feat_md5"))


# Projections and filters --------------------------------------------------------


@query(sql("SELECT node_id FROM nodes WHERE split = 'val'", "nodes"))
def split_nodes(spark, sf):
    return stats.split_nodes(fx.nodes(spark, sf), "val")


@query(sql("SELECT node_id, degree FROM in_deg WHERE degree < 8", "in_deg"))
def low_degree_candidates(spark, sf):
    return stats.low_degree_candidates(fx.edges(spark, sf), fx.ids(spark, sf), 8)


_HOT = "SELECT node_id FROM in_deg WHERE degree >= 20"


def _hot(spark, sf):
    return stats.degrees(fx.edges(spark, sf), fx.ids(spark, sf)).filter("degree >= 20").select("node_id")


@query(sql("SELECT i.node_id, count(e.dst) FILTER (WHERE e.dst IN (SELECT node_id FROM hot)) AS n_in, "
           "count(e.dst) FILTER (WHERE e.dst NOT IN (SELECT node_id FROM hot)) AS n_out "
           "FROM ids i LEFT JOIN edges e ON e.src = i.node_id GROUP BY i.node_id", "in_deg", hot=_HOT))
def split_edges_counts(spark, sf):
    return stats_split(spark, sf)


def stats_split(spark, sf):
    return sets.split_degrees(fx.edges(spark, sf), fx.ids(spark, sf), _hot(spark, sf))


@query(sql("SELECT src, dst, dst IN (SELECT node_id FROM hot) AS inside FROM edges", "in_deg", hot=_HOT))
def split_edges_by_nodes(spark, sf):
    inside, outside = sets.split_edges_by_nodes(fx.edges(spark, sf), _hot(spark, sf))
    return inside.withColumn("inside", F.lit(True)).unionByName(outside.withColumn("inside", F.lit(False)))


@query(sql("SELECT n.ntype, n.node_id, n.node_id + o.key_off AS row_id FROM typed_nodes n JOIN offsets o USING (ntype)", "offsets"))
def encode_type_offset(spark, sf):
    return gather.encode_type_offset(fx.typed_nodes(spark, sf), _typed_offsets(spark, sf)).select("ntype", "node_id", "row_id")


@query(sql("SELECT n.ntype, n.node_id, n.node_id + o.key_off AS row_id FROM typed_nodes n JOIN offsets o USING (ntype)", "offsets"))
def decode_type_offset(spark, sf):
    offsets = _typed_offsets(spark, sf)
    rows = gather.encode_type_offset(fx.typed_nodes(spark, sf), offsets).select("row_id")
    return gather.decode_type_offset(rows, offsets).select("ntype", "node_id", "row_id")


@query(sql("SELECT count(*) AS total, count(*) - count(label) AS n_missing, "
           "round((count(*) - count(label)) / count(*)::DOUBLE, 6) AS missing_share, "
           "(SELECT string_agg(label::VARCHAR, ',' ORDER BY node_id) FROM (SELECT node_id, label FROM nodes WHERE label IS NOT NULL "
           "ORDER BY node_id LIMIT 10)) AS sample FROM nodes", "nodes"))
def label_profile(spark, sf):
    return stats.label_profile(fx.nodes(spark, sf)).select(
        "total", "n_missing", F.round("missing_share", 6).alias("missing_share"), F.array_join("sample", ",").alias("sample"))


@query(sql("SELECT node_id, coalesce(CASE WHEN row_number() OVER (ORDER BY md5('7|' || node_id), node_id) <= "
           "CAST(floor((SELECT count(*) FROM ids) * 0.25::DOUBLE) AS BIGINT) "
           "THEN ('0x' || substr(md5('7|label|' || node_id), 1, 15))::BIGINT % 19 END, -1) AS label FROM ids", "ids"))
def synthesize_labels(spark, sf):
    return stats.synthesize_labels(fx.ids(spark, sf), 0.25, 19, 7).withColumn("label", F.coalesce("label", F.lit(-1)))


@query(sql("SELECT batch_id, pos, node_id, node_id // 4 AS page_id FROM trace", "trace"))
def attach_page(spark, sf):
    return access.attach_page(fx.trace(spark, sf), 4, "node_id").select("batch_id", "pos", "node_id", "page_id")


@query(sql("SELECT a.i, a.v + b.v AS v FROM arr a JOIN arr_price b USING (i)", "arr", "arr_price"))
def vector_add(spark, sf):
    return stats.vector_add(fx.arr(spark, sf), fx.arr_price(spark, sf))


# Joins --------------------------------------------------------------------------

_GATHERED = f"SELECT t.batch_id, t.pos, t.node_id, {feat_digest_sql('n.feat')} AS feat_md5 FROM trace t JOIN nodes n USING (node_id)"


def _feats(spark, sf):
    return fx.nodes(spark, sf).select("node_id", "feat")


@query(sql(_GATHERED, "trace", "nodes"))
def gather_features(spark, sf):
    return gather.gather_features(fx.trace(spark, sf), _feats(spark, sf)).select("batch_id", "pos", "node_id", feat_digest().alias("feat_md5"))


@query(sql(f"SELECT t.batch_id, t.pos, t.node_id, {feat_digest_sql('f.feat')} AS feat_md5 FROM trace t JOIN typed_features f "
           "ON f.node_id = t.node_id + (SELECT key_off FROM offsets WHERE ntype = 'part')", "trace", "typed_features"))
def gather_features_with_offset(spark, sf):
    off = _typed_offsets(spark, sf).filter("ntype = 'part'").first()["key_off"]
    out = gather.gather_features(fx.trace(spark, sf), fx.typed_features(spark, sf), off)
    return out.select("batch_id", "pos", "node_id", feat_digest().alias("feat_md5"))


@query(sql(f"SELECT i.batch_id, i.ntype, i.node_id, {feat_digest_sql('f.feat')} AS feat_md5 FROM typed_index i JOIN offsets o USING (ntype) "
           "JOIN typed_features f ON f.node_id = i.node_id + o.key_off", "typed_index", "typed_features"))
def gather_features_hetero(spark, sf):
    out = gather.gather_features_hetero(fx.typed_index(spark, sf), fx.typed_features(spark, sf), _typed_offsets(spark, sf))
    return out.select("batch_id", "ntype", "node_id", feat_digest().alias("feat_md5"))


@query(sql(_GATHERED, "trace", "nodes"))
def gather_batches(spark, sf):
    return gather.gather_batches(fx.trace(spark, sf), _feats(spark, sf)).select("batch_id", "pos", "node_id", feat_digest().alias("feat_md5"))


_PINNED = ("SELECT node_id FROM in_deg ORDER BY degree DESC, node_id "
           "LIMIT (SELECT CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM ids)")


def _pinned(spark, sf, share=0.2):
    ranking = stats.degrees(fx.edges(spark, sf), fx.ids(spark, sf)).withColumnRenamed("degree", "score")
    return gather.cached_features(gather.pin_features(_feats(spark, sf), ranking, share))


@query(sql(_GATHERED.replace("AS feat_md5", "AS feat_md5, CASE WHEN t.node_id IN (SELECT node_id FROM pinned) THEN 'pinned' ELSE 'storage' END AS tier"),
           "trace", "nodes", "in_deg", pinned=_PINNED))
def gather_tiered(spark, sf):
    out = gather.gather_tiered(fx.trace(spark, sf), _feats(spark, sf), _pinned(spark, sf))
    return out.select("batch_id", "pos", "node_id", feat_digest().alias("feat_md5"), "tier")


@query(sql(f"SELECT node_id, {feat_digest_sql()} AS feat_md5 FROM nodes WHERE node_id IN (SELECT node_id FROM pinned)", "nodes", "in_deg", pinned=_PINNED))
def pin_features(spark, sf):
    return _pinned(spark, sf).select("node_id", feat_digest().alias("feat_md5"))


_LAYOUT = "SELECT row_number() OVER (ORDER BY score DESC, node_id) - 1 AS pos, node_id FROM scores"


def _layout(spark, sf):
    return ordering.top_nodes(fx.scores(spark, sf), share=1.0).select(F.col("rank").alias("pos"), "node_id")


@query(sql("SELECT t.batch_id, t.pos, t.node_id, l.pos AS slot FROM trace t JOIN lay l USING (node_id)", "trace", "scores", lay=_LAYOUT))
def remap_ids(spark, sf):
    return gather.remap_ids(fx.trace(spark, sf), _layout(spark, sf)).select("batch_id", "pos", "node_id", "slot")


@query(sql("SELECT src % 4 AS batch_id, 0::BIGINT AS layer, src, dst FROM edges", "edges"))
def block_to_global(spark, sf):
    """All edges as four blocks with local ids, mapped back to global ids."""
    both = fx.edges(spark, sf).select((F.col("src") % 4).alias("batch_id"), F.lit(0).cast("bigint").alias("layer"), "src", "dst")
    local = {}
    for end in ("src", "dst"):
        ids = both.select("batch_id", "layer", F.col(end).alias("node_id")).distinct()
        local[end] = materialize(scan.grouped_rank(ids, ["batch_id", "layer"], "node_id", "local_id"), "local")
    key = ["batch_id", "layer"]
    u = local["src"].select(*key, F.col("node_id").alias("src"), F.col("local_id").alias("u"))
    v = local["dst"].select(*key, F.col("node_id").alias("dst"), F.col("local_id").alias("v"))
    block = materialize(both.join(u, [*key, "src"]).join(v, [*key, "dst"]).select(*key, "u", "v"), "block")
    return gather.block_to_global(block, local["src"], local["dst"])


@query(sql("SELECT a.set_id AS i, b.set_id AS j, count(*) AS n FROM near a JOIN near b ON a.node_id = b.node_id AND a.set_id <> b.set_id GROUP BY 1, 2",
           "in_deg", "edges", low="SELECT node_id FROM in_deg WHERE degree < 12 ORDER BY degree DESC, node_id LIMIT 100",
           near="SELECT node_id AS set_id, node_id FROM low UNION SELECT dst, src FROM edges WHERE dst IN (SELECT node_id FROM low)"))
def pairwise_overlap(spark, sf):
    """Overlaps among the neighbourhoods of the 100 low-degree seeds."""
    e = fx.edges(spark, sf)
    seeds = ordering.top_low_degree(e, fx.ids(spark, sf), 12, 100).select(F.col("node_id").alias("set_id"), "node_id")
    return sets.pairwise_overlap(sampling.khop_full(e, seeds, 1))


_CUT = ("SELECT src AS group_id, src, rn - 1 AS slot, dst AS node_id FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) "
        "AS rn FROM edges) WHERE rn <= 3")


def _cut_groups(spark, sf, shift=0):
    """First three neighbours of every source; ``shift`` spoils the members of some groups."""
    top = scan.top_k_per_group(fx.edges(spark, sf), ["src"], [F.col("dst")], 3)
    return top.select(F.col("src").alias("group_id"), "src", (F.col("rn") - 1).cast("bigint").alias("slot"),
                      (F.col("dst") + F.when(F.col("src") % 5 == 0, F.lit(shift)).otherwise(0)).alias("node_id"))


@query(sql("SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid FROM ("
           "SELECT group_id, bool_and(m.node_id = m.src OR e.src IS NOT NULL) AS ok FROM moved m LEFT JOIN edges e "
           "ON e.src = m.src AND e.dst = m.node_id GROUP BY group_id)", "edges", cut=_CUT,
           moved="SELECT group_id, src, slot, node_id + CASE WHEN src % 5 = 0 THEN 1 ELSE 0 END AS node_id FROM cut"))
def validate_groups(spark, sf):
    return sets.validate_groups(_cut_groups(spark, sf, shift=1), fx.edges(spark, sf))


@query(sql("SELECT coalesce(a.i, b.i) AS i, a.v AS left_value, b.v AS right_value FROM arr a FULL OUTER JOIN other b ON a.i = b.i "
           "WHERE a.v IS DISTINCT FROM b.v", "arr", other="SELECT i, CASE WHEN i % 3 = 0 THEN v + 1 ELSE v END AS v FROM arr"))
def diff_tables(spark, sf):
    a = fx.arr(spark, sf)
    b = a.select("i", F.when(F.col("i") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return sets.diff_tables(a, b, "i", "v")


@query(sql("SELECT e.src, e.dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.src = e.src AND c.node_id = e.dst) "
           "UNION ALL SELECT DISTINCT src, group_id + 1000000 FROM cut", "edges", cut=_CUT))
def compress_with_supernodes(spark, sf):
    return sets.compress_with_supernodes(fx.edges(spark, sf), _cut_groups(spark, sf), 1_000_000)


@query(sql("SELECT (SELECT count(*) FROM cov) AS expected_deleted, (SELECT count(*) FROM edges e JOIN cov c ON e.src = c.src AND e.dst = c.dst) "
           "AS actual_deleted, (SELECT count(DISTINCT group_id) FROM moved) AS added", "edges", cut=_CUT,
           moved="SELECT group_id, src, slot, node_id + CASE WHEN src % 5 = 0 THEN 1 ELSE 0 END AS node_id FROM cut",
           cov="SELECT DISTINCT src, node_id AS dst FROM moved"))
def supernode_report(spark, sf):
    return _long(sets.supernode_report(fx.edges(spark, sf), _cut_groups(spark, sf, shift=1)), "expected_deleted", "actual_deleted", "added")


@query(sql("SELECT DISTINCT a.batch_id, a.node_id FROM visits a JOIN visits b ON a.node_id = b.node_id "
           "AND b.batch_id BETWEEN a.batch_id + 1 AND a.batch_id + 8", "visits"))
def prefetch_intersection(spark, sf):
    return access.prefetch_intersection(fx.trace(spark, sf), 8)


# Aggregations -------------------------------------------------------------------


@query(sql("SELECT CAST(sum(d) AS BIGINT) AS total_edges, count(*) AS unique_sources, max(d) AS max_out_degree, round(avg(d), 6) AS avg_out_degree, "
           "median(d) AS median_out_degree FROM (SELECT src, count(*) AS d FROM edges GROUP BY src)", "edges"))
def graph_stats(spark, sf):
    return stats.graph_stats(fx.edges(spark, sf)).withColumn("avg_out_degree", F.round("avg_out_degree", 6))


@query(sql("SELECT i.node_id, i.degree AS in_degree, o.degree AS out_degree FROM in_deg i JOIN out_deg o USING (node_id)", "in_deg", "out_deg"))
def degrees(spark, sf):
    e, n = fx.edges(spark, sf), fx.ids(spark, sf)
    return stats.degrees(e, n, "in").withColumnRenamed("degree", "in_degree").join(
        stats.degrees(e, n, "out").withColumnRenamed("degree", "out_degree"), "node_id")


@query(sql("SELECT g.degree, coalesce(h.n, 0) AS n FROM (SELECT unnest(range((SELECT max(d) FROM deg) + 1)) AS degree) g "
           "LEFT JOIN (SELECT d, count(*) AS n FROM deg GROUP BY d) h ON h.d = g.degree", "edges",
           deg="SELECT src, count(*) AS d FROM edges GROUP BY src"))
def degree_histogram(spark, sf):
    return stats.degree_histogram(fx.edges(spark, sf))


@query(sql("SELECT src, o // 16 AS chunk, string_agg(dst::VARCHAR, ',' ORDER BY o) AS neighbors, count(*) AS n FROM "
           "(SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS o FROM edges) GROUP BY 1, 2", "edges"))
def build_adjacency(spark, sf):
    return stats.build_adjacency(fx.edges(spark, sf), chunk=16).withColumn("neighbors", F.array_join("neighbors", ","))


@query(sql("SELECT node_id, 0::BIGINT AS slot, node_id AS member FROM ids UNION ALL "
           "SELECT dst, row_number() OVER (PARTITION BY dst ORDER BY src), src FROM edges", "ids", "edges"))
def in_neighborhoods(spark, sf):
    return stats.in_neighborhoods(fx.edges(spark, sf), fx.ids(spark, sf))


@query(sql("SELECT node_id, degree + 1 AS size FROM in_deg", "in_deg"))
def neighborhood_sizes(spark, sf):
    return stats.neighborhood_sizes(fx.edges(spark, sf), fx.ids(spark, sf))


@query(sql("SELECT CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM arr_price", "arr_price"))
def reduce_sum(spark, sf):
    return stats.reduce_sum(fx.arr_price(spark, sf))


@query(sql("SELECT start // 64 AS page_id, count(*) AS n FROM (SELECT node_id, coalesce(sum(degree) OVER (ORDER BY node_id "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM out_deg) GROUP BY 1", "out_deg"))
def page_histogram(spark, sf):
    deg = stats.degrees(fx.edges(spark, sf), fx.ids(spark, sf), "out")
    return stats.page_histogram(scan.prefix_scan(deg, "node_id", "degree", "offset", inclusive=False), 64)


@query(sql("SELECT node_id, count(*) AS n_batches FROM visits GROUP BY node_id", "visits"))
def access_frequency(spark, sf):
    return access.access_frequency(fx.trace(spark, sf))


@query(sql("SELECT coalesce(batch_id, -1) AS batch_id, count(*) AS accesses, count(*) FILTER (WHERE p) AS pinned, count(*) FILTER (WHERE NOT p) AS storage, "
           "round(count(*) FILTER (WHERE p) / count(*)::DOUBLE, 6) AS hit_ratio FROM (SELECT batch_id, node_id IN (SELECT node_id FROM pinned) AS p "
           "FROM trace) t GROUP BY ROLLUP (t.batch_id)", "trace", "in_deg", pinned=_PINNED))
def tier_stats(spark, sf):
    tagged = gather.tag_tier(fx.trace(spark, sf), _pinned(spark, sf))
    out = gather.tier_stats(tagged).withColumn("hit_ratio", F.round("hit_ratio", 6))
    return out.withColumn("batch_id", F.coalesce("batch_id", F.lit(-1)))


@query(sql("SELECT dst % 3 AS batch_id, 1::BIGINT AS layer, dst, 0::BIGINT AS chunk, string_agg(src::VARCHAR, ',' ORDER BY src) AS neighbors, "
           "count(*) AS n FROM edges GROUP BY dst", "edges"))
def neighbor_map(spark, sf):
    blocks = fx.edges(spark, sf).select((F.col("dst") % 3).alias("batch_id"), F.lit(1).cast("bigint").alias("layer"), "src", "dst")
    return stats.neighbor_map(blocks).withColumn("neighbors", F.array_join("neighbors", ","))


_STORE_SQL = ("SELECT count(*) AS group_slots, (SELECT count(*) FROM ids WHERE node_id NOT IN (SELECT node_id FROM cut)) AS uncovered, "
              "count(*) + (SELECT count(*) FROM ids WHERE node_id NOT IN (SELECT node_id FROM cut)) AS total_slots, "
              "round((count(*) + (SELECT count(*) FROM ids WHERE node_id NOT IN (SELECT node_id FROM cut))) / (SELECT count(*) FROM ids)::DOUBLE, 6) "
              "AS inflation FROM cut")


@query(sql(_STORE_SQL, "ids", "edges", cut=_CUT))
def storage_report(spark, sf):
    return stats.storage_report(_cut_groups(spark, sf), fx.ids(spark, sf)).withColumn("inflation", F.round("inflation", 6))


@query(sql("SELECT round(avg(CASE WHEN node_id % 10 = label THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy, count(*) AS n FROM nodes WHERE label IS NOT NULL", "nodes"))
def accuracy(spark, sf):
    guess = fx.nodes(spark, sf).select("label", (F.col("node_id") % 10).alias("prediction"))
    return stats.accuracy(guess).withColumn("accuracy", F.round("accuracy", 6))


@query(sql("SELECT batch_id, count(*) AS accesses, count(DISTINCT node_id) AS nodes, count(DISTINCT node_id // 4) AS pages FROM trace GROUP BY 1", "trace"))
def batch_counts(spark, sf):
    return access.batch_counts(fx.trace(spark, sf), 4)


_VOLUME = ("SELECT r AS rows_requested, p AS pages_moved, r * 4096 AS bytes_requested, p * 16384 AS bytes_moved, "
           "round(p * 16384 / (r * 4096)::DOUBLE, 6) AS amplification FROM ")


@query(sql(_VOLUME + "(SELECT (SELECT count(*) FROM trace) AS r, (SELECT count(*) FROM (SELECT DISTINCT batch_id, node_id // 4 FROM trace)) AS p)", "trace"))
def dataset_volume(spark, sf):
    trace = fx.trace(spark, sf)
    out = access.dataset_volume(trace, access.pages_raw(trace, 4), 4096, 16384)
    return out.withColumn("amplification", F.round("amplification", 6))


# Windows and scans --------------------------------------------------------------


@query(sql("SELECT i, v, CAST(sum(v) OVER (ORDER BY i) AS BIGINT) AS running FROM arr_price", "arr_price"))
def prefix_scan(spark, sf):
    return scan.prefix_scan(fx.arr_price(spark, sf), "i", "v", block=1024)


@query(sql("SELECT batch_id, size, CAST(coalesce(sum(size) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) "
           "AS start FROM (SELECT batch_id, count(*) AS size FROM trace GROUP BY 1)", "trace"))
def exclusive_offsets(spark, sf):
    sizes = fx.trace(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
    return scan.prefix_scan(sizes, "batch_id", "size", "start", inclusive=False)


@query(sql("SELECT batch_id, node_id, count(*) OVER (PARTITION BY node_id ORDER BY batch_id RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS reuses "
           "FROM visits", "visits"))
def lookahead_reuse(spark, sf):
    return access.lookahead_reuse(fx.trace(spark, sf), 8, block=64)


@query(sql("SELECT batch_id, node_id, coalesce(batch_id - lag(batch_id) OVER (PARTITION BY node_id ORDER BY batch_id), -1) AS gap FROM visits", "visits"))
def reuse_gap(spark, sf):
    return access.reuse_gap(fx.trace(spark, sf), block=64).withColumn("gap", F.coalesce("gap", F.lit(-1)))


@query(sql("SELECT batch_id, count(*) AS nodes, count(*) FILTER (WHERE gap IS NULL) AS cold, round(count(*) FILTER (WHERE gap IS NULL) / "
           "count(*)::DOUBLE, 6) AS cold_share FROM (SELECT batch_id, batch_id - lag(batch_id) OVER (PARTITION BY node_id ORDER BY batch_id) AS gap "
           "FROM visits) GROUP BY 1", "visits"))
def cold_share(spark, sf):
    return access.cold_share(fx.trace(spark, sf)).withColumn("cold_share", F.round("cold_share", 6))


# Sorts, top-k, batches ----------------------------------------------------------


@query(sql("SELECT src, dst FROM edges ORDER BY src, dst", "edges"))
def sort_edges(spark, sf):
    return ordering.sort_edges(fx.edges(spark, sf))


@query(sql("SELECT node_id, score, rank FROM (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS rank FROM scores) "
           "WHERE rank < CAST(floor((SELECT count(*) FROM scores) * 0.1::DOUBLE) AS BIGINT)", "scores"))
def top_nodes(spark, sf):
    return ordering.top_nodes(fx.scores(spark, sf), share=0.1)


@query(sql("SELECT node_id, score, rank FROM (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS rank FROM scores) "
           "WHERE rank < (SELECT CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) FROM scores)", "scores"))
def top_nodes_ranked(spark, sf):
    """The branch for a large k: a distributed rank and a filter."""
    return ordering.top_nodes(fx.scores(spark, sf), share=0.7, small=0)


@query(sql("SELECT node_id, degree, row_number() OVER (ORDER BY degree DESC, node_id) - 1 AS rank FROM in_deg WHERE degree < 12 "
           "ORDER BY degree DESC, node_id LIMIT 100", "in_deg"))
def top_low_degree(spark, sf):
    return ordering.top_low_degree(fx.edges(spark, sf), fx.ids(spark, sf), 12, 100)


@query(sql("SELECT node_id, degree, score, row_number() OVER (ORDER BY degree, score DESC, node_id) - 1 AS up, "
           "row_number() OVER (ORDER BY degree DESC, score DESC, node_id) - 1 AS down FROM out_deg JOIN scores USING (node_id)", "out_deg", "scores"))
def processing_order(spark, sf):
    base = stats.degrees(fx.edges(spark, sf), fx.ids(spark, sf), "out").join(fx.scores(spark, sf), "node_id")
    up = ordering.processing_order(base, "degree_asc").withColumnRenamed("rank", "up")
    down = ordering.processing_order(base, "degree_desc").select("node_id", F.col("rank").alias("down"))
    return up.join(down, "node_id")


BATCH_SQL = ("SELECT rn // 256 AS batch_id, rn % 256 AS pos, node_id FROM (SELECT node_id, row_number() OVER "
             "(ORDER BY md5('11|0|' || node_id), node_id) - 1 AS rn FROM nodes WHERE split = 'train')")


def train_batches(spark, sf, **kw):
    return ordering.make_batches(stats.split_nodes(fx.nodes(spark, sf), "train"), 256, seed=11, **kw)


@query(sql(BATCH_SQL, "nodes"))
def make_batches(spark, sf):
    return train_batches(spark, sf)


@query(sql("SELECT batch_id, pos, node_id FROM b WHERE batch_id < (SELECT count(*) // 256 FROM b)", "nodes", b=BATCH_SQL))
def make_batches_drop_last(spark, sf):
    return train_batches(spark, sf, drop_last=True)


@query(sql("SELECT rn // 256 AS batch_id, rn % 256 AS pos, node_id FROM (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS rn FROM ids)", "ids"))
def make_batches_in_order(spark, sf):
    return ordering.make_batches(fx.ids(spark, sf), 256, shuffle=False)


# Set operations -----------------------------------------------------------------


@query(sql("SELECT src, dst FROM edges UNION ALL SELECT node_id, node_id FROM ids", "edges", "ids"))
def add_self_loops(spark, sf):
    return sets.add_self_loops(fx.edges(spark, sf), fx.ids(spark, sf), "always")


@query(sql("SELECT src, dst FROM base UNION SELECT node_id, node_id FROM ids", "edges", "ids",
           base="SELECT src, dst FROM edges UNION SELECT src, src FROM edges WHERE src % 2 = 0"))
def add_missing_self_loops(spark, sf):
    e = fx.edges(spark, sf)
    base = e.union(e.filter("src % 2 = 0").select("src", F.col("src").alias("dst"))).distinct()
    return sets.add_self_loops(base, fx.ids(spark, sf), "missing")


@query(sql("SELECT node_id FROM nodes WHERE split = 'train' UNION SELECT node_id FROM in_deg WHERE degree < 10 ORDER BY node_id", "nodes", "in_deg"))
def union_nodes(spark, sf):
    low = stats.low_degree_candidates(fx.edges(spark, sf), fx.ids(spark, sf), 10)
    return sets.union_nodes(stats.split_nodes(fx.nodes(spark, sf), "train"), low)


@query(sql("SELECT node_id FROM nodes WHERE split = 'train' INTERSECT SELECT node_id FROM in_deg WHERE degree < 10", "nodes", "in_deg"))
def set_intersection(spark, sf):
    low = stats.low_degree_candidates(fx.edges(spark, sf), fx.ids(spark, sf), 10)
    return sets.set_intersection(stats.split_nodes(fx.nodes(spark, sf), "train"), low)


@query(sql("SELECT node_id FROM ids WHERE node_id NOT IN (SELECT node_id FROM cut) ORDER BY node_id", "ids", "edges", cut=_CUT))
def uncovered_nodes(spark, sf):
    return sets.uncovered_nodes(fx.ids(spark, sf), _cut_groups(spark, sf))
