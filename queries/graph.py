"""Sampling and graph algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import algos, feed, gather, ordering, partition, sampling, stats
from nodeloom.plans.store import materialize
from queries import fixtures as fx
from queries.fixtures import feat_digest, feat_digest_sql, sql
from queries.relational import BATCH_SQL, _typed_offsets, train_batches

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return register


# Neighbour sampling in SQL ------------------------------------------------------


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def floyd_sql(asked: str, keys: str, fanout: int, *parts: str) -> str:
    """Ordinals drawn per row of ``asked`` (keys, deg), as the library draws them."""
    cols = f"{keys}, deg"
    inner = f"SELECT {cols}, " + ", ".join(
        f"deg - {fanout} + {i} AS j{i}, {hash_sql(*parts, f'(deg - {fanout} + {i})')} % (deg - {fanout} + {i} + 1) AS t{i}"
        for i in range(fanout)) + f" FROM {asked} WHERE deg > {fanout}"
    for i in range(fanout):
        earlier = ", ".join(f"s{e}" for e in range(i))
        pick = f"CASE WHEN t{i} IN ({earlier}) THEN j{i} ELSE t{i} END" if i else "t0"
        inner = f"SELECT *, {pick} AS s{i} FROM ({inner})"
    picked = ", ".join(f"s{i}" for i in range(fanout))
    return (f"SELECT {keys}, unnest([{picked}]) AS ord FROM ({inner}) UNION ALL "
            f"SELECT {keys}, unnest(range(deg)) AS ord FROM {asked} WHERE deg <= {fanout}")


INDEX = {
    "idx": "SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS ord FROM edges",
    "deg": "SELECT dst, count(*) AS deg FROM edges GROUP BY dst",
}


def sampled_ctes(seeds: str, fanouts: list[int], seed: int) -> dict[str, str]:
    """CTEs blk<layer> and fr<layer> (the frontier below the layer)."""
    out = dict(INDEX)
    frontier = f"SELECT DISTINCT batch_id, node_id FROM ({seeds})"
    out[f"fr{len(fanouts)}"] = frontier
    for layer in reversed(range(len(fanouts))):
        out[f"ask{layer}"] = f"SELECT f.batch_id, d.dst, d.deg FROM fr{layer + 1} f JOIN deg d ON d.dst = f.node_id"
        out[f"ord{layer}"] = floyd_sql(f"ask{layer}", "batch_id, dst", fanouts[layer], str(seed), "0", str(layer), "''", "batch_id", "dst")
        out[f"blk{layer}"] = f"SELECT o.batch_id, i.src, o.dst FROM ord{layer} o JOIN idx i ON i.dst = o.dst AND i.ord = o.ord"
        out[f"fr{layer}"] = f"SELECT batch_id, node_id FROM fr{layer + 1} UNION SELECT batch_id, src FROM blk{layer}"
    return out


def blocks_sql(layers: int) -> str:
    return " UNION ALL ".join(f"SELECT batch_id, {i}::BIGINT AS layer, src, dst FROM blk{i}" for i in range(layers))


FANOUTS = [4, 3]


def _blocks(spark, sf, fanouts=FANOUTS):
    return sampling.sample_neighbors(fx.edges(spark, sf), train_batches(spark, sf), fanouts, seed=5)


@query(sql(blocks_sql(2), "nodes", "edges", **sampled_ctes(BATCH_SQL, FANOUTS, 5)))
def sample_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf)[0]


@query(sql("SELECT batch_id, node_id FROM fr0", "nodes", "edges", **sampled_ctes(BATCH_SQL, FANOUTS, 5)))
def sample_input_nodes(spark, sf):
    return _blocks(spark, sf)[1]


_PIN = ("SELECT node_id FROM in_deg ORDER BY degree DESC, node_id LIMIT (SELECT CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM ids)")


@query(sql("SELECT coalesce(batch_id, -1) AS batch_id, count(*) AS accesses, count(*) FILTER (WHERE p) AS pinned, count(*) FILTER (WHERE NOT p) AS storage, "
           "round(count(*) FILTER (WHERE p) / count(*)::DOUBLE, 6) AS hit_ratio FROM (SELECT batch_id, node_id IN (SELECT node_id FROM pinned) AS p FROM fr0) t "
           "GROUP BY ROLLUP (t.batch_id)", "nodes", "edges", "in_deg", **sampled_ctes(BATCH_SQL, FANOUTS, 5), pinned=_PIN))
def sampled_batch_tiers(spark, sf):
    """Per training batch: the share of its sampled input features that the pinned top 20 % serve."""
    _, inputs = _blocks(spark, sf)
    ranking = stats.degrees(fx.edges(spark, sf), fx.ids(spark, sf)).withColumnRenamed("degree", "score")
    features = fx.nodes(spark, sf).select("node_id", "feat")
    pinned = gather.cached_features(gather.pin_features(features, ranking, 0.2))
    out = gather.tier_stats(gather.gather_tiered(inputs, features, pinned))
    return out.withColumn("batch_id", F.coalesce("batch_id", F.lit(-1))).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query(sql("SELECT node_id AS set_id, node_id FROM low UNION SELECT dst, src FROM edges WHERE dst IN (SELECT node_id FROM low) UNION "
           "SELECT b.dst, a.src FROM edges a JOIN edges b ON a.dst = b.src WHERE b.dst IN (SELECT node_id FROM low)", "in_deg", "edges",
           low="SELECT node_id FROM in_deg WHERE degree < 12 ORDER BY degree DESC, node_id LIMIT 100"))
def khop_full(spark, sf):
    """Two-hop sets around the 100 low-degree seeds."""
    seeds = ordering.top_low_degree(fx.edges(spark, sf), fx.ids(spark, sf), 12, 100)
    return sampling.khop_full(fx.edges(spark, sf), seeds.select(F.col("node_id").alias("set_id"), "node_id"), 2)


@query(sql(f"SELECT f.batch_id, f.node_id, {feat_digest_sql('n.feat')} AS feat_md5 FROM fr0 f JOIN nodes n USING (node_id)", "nodes", "edges",
           **sampled_ctes(BATCH_SQL, FANOUTS, 5)))
def minibatch_feed(spark, sf):
    """Training ids to sampled inputs with their vectors, in one call."""
    features = fx.nodes(spark, sf).select("node_id", "feat")
    out = feed.minibatch_feed(fx.edges(spark, sf), features, train_batches(spark, sf), feed.neighbor_sampler(FANOUTS, 5))
    return out.features.select("batch_id", "node_id", feat_digest().alias("feat_md5"))


def _typed_sql() -> dict[str, str]:
    out = {
        "tidx": "SELECT *, row_number() OVER (PARTITION BY etype, dst ORDER BY src) - 1 AS ord FROM typed_edges",
        "tdeg": "SELECT etype, src_type, dst_type, dst, count(*) AS deg FROM typed_edges GROUP BY ALL",
        "fr2": "SELECT DISTINCT s_suppkey // 16 AS batch_id, 'supplier' AS ntype, s_suppkey AS node_id FROM supplier",
    }
    keys = "batch_id, etype, src_type, dst_type, dst"
    for layer, fan in ((1, 3), (0, 4)):
        out[f"ask{layer}"] = (f"SELECT f.batch_id, d.etype, d.src_type, d.dst_type, d.dst, d.deg FROM fr{layer + 1} f "
                              "JOIN tdeg d ON d.dst_type = f.ntype AND d.dst = f.node_id")
        out[f"ord{layer}"] = floyd_sql(f"ask{layer}", keys, fan, "5", "0", str(layer), "etype", "batch_id", "dst")
        out[f"blk{layer}"] = (f"SELECT o.batch_id, o.etype, o.src_type, o.dst_type, i.src, o.dst FROM ord{layer} o "
                              "JOIN tidx i ON i.etype = o.etype AND i.dst = o.dst AND i.ord = o.ord")
        out[f"fr{layer}"] = f"SELECT batch_id, ntype, node_id FROM fr{layer + 1} UNION SELECT batch_id, src_type, src FROM blk{layer}"
    return out


@query(sql(" UNION ALL ".join(f"SELECT batch_id, {i}::BIGINT AS layer, etype, src_type, dst_type, src, dst FROM blk{i}" for i in (0, 1)),
           "typed_edges", **_typed_sql()))
def sample_neighbors_hetero(spark, sf):
    seeds = fx.table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 16).cast("bigint").alias("batch_id"), F.lit("supplier").alias("ntype"), F.col("s_suppkey").alias("node_id"))
    return sampling.sample_neighbors_hetero(fx.typed_edges(spark, sf), seeds, [4, 3], seed=5)[0]


@query(sql(f"SELECT f.batch_id, f.ntype, f.node_id, {feat_digest_sql('t.feat')} AS feat_md5 FROM fr0 f JOIN offsets o USING (ntype) "
           "JOIN typed_features t ON t.node_id = f.node_id + o.key_off", "typed_edges", "typed_features", **_typed_sql()))
def minibatch_feed_hetero(spark, sf):
    """The typed feed: suppliers as seeds, every input node with its global row's vector."""
    seeds = fx.table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 16).cast("bigint").alias("batch_id"), F.lit("supplier").alias("ntype"), F.col("s_suppkey").alias("node_id"))
    out = feed.minibatch_feed_hetero(fx.typed_edges(spark, sf), fx.typed_features(spark, sf), _typed_offsets(spark, sf), seeds, [4, 3], seed=5)
    return out.features.select("batch_id", "ntype", "node_id", feat_digest().alias("feat_md5"))


# Layer-wise sampling ------------------------------------------------------------

_EW = "SELECT e.src, e.dst, 1.0::DOUBLE / d.n AS w FROM edges e JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) d USING (dst)"
_PROB = ("SELECT s.batch_id, e.src AS node_id, sum(e.w * e.w) AS prob FROM ew e JOIN {seeds} s ON s.node_id = e.dst GROUP BY 1, 2")


def uniform_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _pick_sql(prob: str, k: int, seed: int, layer: int) -> str:
    key = f"ln({uniform_sql(str(seed), str(layer), 'batch_id', 'node_id')}) / prob"
    return (f"SELECT batch_id, node_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {key} DESC, node_id) AS rn "
            f"FROM {prob}) WHERE rn <= {k}")


def _block_sql(picked: str, seeds: str) -> str:
    return (f"SELECT batch_id, src, dst, t * (count(*) OVER (PARTITION BY batch_id, dst)) / (sum(t) OVER (PARTITION BY batch_id, dst)) AS w FROM "
            f"(SELECT s.batch_id, e.src, e.dst, e.w / p.prob AS t FROM ew e JOIN {seeds} s ON s.node_id = e.dst "
            f"JOIN {picked} p ON p.batch_id = s.batch_id AND p.node_id = e.src)")


_SEEDS = {"ew": _EW, "seeds": f"SELECT batch_id, node_id FROM ({BATCH_SQL})"}


def _edges_w(spark, sf):
    return materialize(sampling.edge_weights_by_dst(fx.edges(spark, sf)), "weights")


def _seeds(spark, sf):
    return train_batches(spark, sf).select("batch_id", "node_id")


@query(sql("SELECT src, dst, round(w, 6) AS w FROM ew", "edges", ew=_EW))
def edge_weights_by_dst(spark, sf):
    return sampling.edge_weights_by_dst(fx.edges(spark, sf)).withColumn("w", F.round("w", 6))


@query(sql("SELECT batch_id, node_id, round(prob, 6) AS prob FROM p", "edges", "nodes", **_SEEDS, p=_PROB.format(seeds="seeds")))
def layer_importance(spark, sf):
    return sampling.layer_importance(_edges_w(spark, sf), _seeds(spark, sf)).withColumn("prob", F.round("prob", 6))


@query(sql("SELECT batch_id, node_id, 1.0::DOUBLE AS prob FROM p", "edges", "nodes", **_SEEDS, p=_PROB.format(seeds="seeds")))
def layer_importance_uniform(spark, sf):
    return sampling.layer_importance(_edges_w(spark, sf), _seeds(spark, sf), "uniform")


@query(sql("SELECT batch_id, node_id, round(prob, 6) AS prob FROM pick", "edges", "nodes", **_SEEDS, p=_PROB.format(seeds="seeds"),
           pick=_pick_sql("p", 128, 9, 0)))
def select_layer_nodes(spark, sf):
    prob = materialize(sampling.layer_importance(_edges_w(spark, sf), _seeds(spark, sf)), "prob")
    return sampling.select_layer_nodes(prob, 128, seed=9).withColumn("prob", F.round("prob", 6))


@query(sql("SELECT d.batch_id, d.draw, c.node_id FROM draws d JOIN cdf c ON c.batch_id = d.batch_id AND d.u * c.total >= c.lo AND d.u * c.total < c.hi",
           "edges", "nodes", **_SEEDS, p=_PROB.format(seeds="seeds"),
           run="SELECT batch_id, node_id, prob, sum(prob) OVER (PARTITION BY batch_id ORDER BY node_id ROWS UNBOUNDED PRECEDING) AS hi FROM p",
           cdf="SELECT *, hi - prob AS lo, max(hi) OVER (PARTITION BY batch_id) AS total FROM run",
           draws=f"SELECT batch_id, draw, {uniform_sql('9', '0', 'batch_id', 'draw')} AS u FROM (SELECT DISTINCT batch_id FROM p), "
                 "(SELECT unnest(range(128)) AS draw)"))
def select_layer_nodes_replace(spark, sf):
    prob = materialize(sampling.layer_importance(_edges_w(spark, sf), _seeds(spark, sf)), "prob")
    out = sampling.select_layer_nodes(prob, 128, seed=9, replace=True)
    return out.select("batch_id", F.col("draw").cast("bigint").alias("draw"), "node_id")


@query(sql("SELECT batch_id, src, dst, round(w, 6) AS w FROM blk", "edges", "nodes", **_SEEDS, p=_PROB.format(seeds="seeds"),
           pick=_pick_sql("p", 128, 9, 0), blk=_block_sql("pick", "seeds")))
def layer_block(spark, sf):
    ew, seeds = _edges_w(spark, sf), materialize(_seeds(spark, sf), "seeds")
    prob = materialize(sampling.layer_importance(ew, seeds), "prob")
    picked = sampling.select_layer_nodes(prob, 128, seed=9)
    return sampling.layer_block(ew, picked, seeds).withColumn("w", F.round("w", 6))


@query(sql("SELECT batch_id, 1::BIGINT AS layer, src, dst, round(w, 6) AS w FROM b1 UNION ALL "
           "SELECT batch_id, 0::BIGINT, src, dst, round(w, 6) FROM b0", "edges", "nodes", **_SEEDS,
           p1=_PROB.format(seeds="seeds"), k1=_pick_sql("p1", 96, 9, 1), b1=_block_sql("k1", "seeds"),
           s0="SELECT batch_id, node_id FROM seeds UNION SELECT batch_id, node_id FROM k1",
           p0=_PROB.format(seeds="s0"), k0=_pick_sql("p0", 128, 9, 0), b0=_block_sql("k0", "s0")))
def sample_layerwise(spark, sf):
    blocks, _ = sampling.sample_layerwise(_edges_w(spark, sf), _seeds(spark, sf), [128, 96], seed=9)
    return blocks.withColumn("w", F.round("w", 6))


# Partitions ---------------------------------------------------------------------


def _labels_sql(rounds: int) -> dict[str, str]:
    out = {"both_dirs": "SELECT src, dst FROM edges UNION SELECT dst, src FROM edges", "c0": "SELECT node_id, node_id AS comm FROM ids"}
    for r in range(rounds):
        out[f"c{r + 1}"] = (
            f"SELECT node_id, comm FROM (SELECT node_id, comm, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, comm) AS rn FROM ("
            f"SELECT b.dst AS node_id, c.comm, count(*) AS n FROM both_dirs b JOIN c{r} c ON c.node_id = b.src GROUP BY 1, 2 "
            f"UNION ALL SELECT node_id, comm, 0 FROM c{r})) WHERE rn = 1")
    return out


_PARTS = ("SELECT node_id, rn * 8 // (SELECT count(*) FROM ids) AS part FROM (SELECT node_id, row_number() OVER (ORDER BY size DESC, comm, node_id) - 1 AS rn "
          "FROM (SELECT node_id, comm, count(*) OVER (PARTITION BY comm) AS size FROM c3))")


def _parts(spark, sf):
    return materialize(sampling.assign_partitions(fx.edges(spark, sf), fx.ids(spark, sf), 8, 3), "parts")


@query(sql("SELECT node_id, part FROM parts", "ids", "edges", **_labels_sql(3), parts=_PARTS))
def assign_partitions(spark, sf):
    return _parts(spark, sf)


@query(sql("SELECT count(*) FILTER (WHERE a.part <> b.part) AS cut, count(*) AS edges FROM edges e JOIN parts a ON a.node_id = e.src "
           "JOIN parts b ON b.node_id = e.dst", "ids", "edges", **_labels_sql(3), parts=_PARTS))
def edge_cut(spark, sf):
    return sampling.edge_cut(fx.edges(spark, sf), _parts(spark, sf))


@query(sql("SELECT rn * 8 // (SELECT count(*) FROM ids) AS part, count(*) AS nodes FROM (SELECT row_number() OVER (ORDER BY node_id) - 1 AS rn FROM ids) GROUP BY 1",
           "ids"))
def partition_graph_sizes(spark, sf):
    """Nodes per part of the multilevel partition; the cut itself is tested on planted clusters."""
    found = partition.partition_graph(fx.edges(spark, sf), fx.ids(spark, sf), 8, rounds=3)
    return found.parts.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))


_CLUSTERS = ("SELECT o.batch_id, p.node_id FROM parts p JOIN (SELECT part, (row_number() OVER (ORDER BY md5('3|0|' || part), part) - 1) // 2 AS batch_id "
             "FROM (SELECT DISTINCT part FROM parts)) o USING (part)")


@query(sql("SELECT batch_id, node_id FROM cl", "ids", "edges", **_labels_sql(3), parts=_PARTS, cl=_CLUSTERS))
def cluster_batches(spark, sf):
    return sampling.cluster_batches(_parts(spark, sf), 2, seed=3)


@query(sql("SELECT a.batch_id, e.src, e.dst FROM edges e JOIN cl a ON a.node_id = e.src JOIN cl b ON b.node_id = e.dst AND b.batch_id = a.batch_id",
           "ids", "edges", **_labels_sql(3), parts=_PARTS, cl=_CLUSTERS))
def induced_subgraph(spark, sf):
    return sampling.induced_subgraph(fx.edges(spark, sf), sampling.cluster_batches(_parts(spark, sf), 2, seed=3))


_GROUPS = "SELECT src, dst AS node_id FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM edges) WHERE rn <= 4"


def _group_ctes() -> dict[str, str]:
    out = dict(INDEX)
    out["grp"] = _GROUPS
    out["own"] = "SELECT g.src AS dst, g.node_id AS src FROM grp g JOIN edges e ON e.src = g.node_id AND e.dst = g.src"
    out["fr2"] = f"SELECT DISTINCT batch_id, node_id FROM ({BATCH_SQL})"
    for layer, fan in ((1, 3), (0, 4)):
        out[f"ask{layer}"] = f"SELECT f.batch_id, d.dst, d.deg FROM fr{layer + 1} f JOIN deg d ON d.dst = f.node_id"
        out[f"ord{layer}"] = floyd_sql(f"ask{layer}", "batch_id, dst", fan, "5", "0", str(layer), "''", "batch_id", "dst")
        out[f"opt{layer}"] = (f"SELECT batch_id, src, dst, min(pref) AS pref FROM (SELECT o.batch_id, i.src, o.dst, 1 AS pref FROM ord{layer} o "
                              f"JOIN idx i ON i.dst = o.dst AND i.ord = o.ord UNION ALL SELECT f.batch_id, w.src, w.dst, 0 FROM fr{layer + 1} f "
                              "JOIN own w ON w.dst = f.node_id) GROUP BY 1, 2, 3")
        out[f"blk{layer}"] = (f"SELECT batch_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, dst ORDER BY pref, "
                              f"md5(concat_ws('|', 5, 0, {layer}, batch_id, dst, src))) AS rn FROM opt{layer}) WHERE rn <= {fan}")
        out[f"fr{layer}"] = f"SELECT batch_id, node_id FROM fr{layer + 1} UNION SELECT batch_id, src FROM blk{layer}"
    return out


@query(sql(blocks_sql(2), "nodes", "edges", **_group_ctes()))
def sample_group_neighbors(spark, sf):
    from nodeloom.plans.scan import top_k_per_group

    e = fx.edges(spark, sf)
    groups = top_k_per_group(e, ["src"], [F.col("dst")], 4).select("src", F.col("dst").alias("node_id"))
    return sampling.sample_group_neighbors(e, groups, train_batches(spark, sf), [4, 3], seed=5)[0]


# Access patterns over the price array -------------------------------------------


def _slots(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("slot"))


def _pattern(spark, sf, kind, **kw):
    price = fx.arr_price(spark, sf)
    positions = sampling.access_pattern(_slots(spark, sf), price.count(), kind, **kw)
    return sampling.gather_sum(positions, price)


def _pattern_sql(pos: str) -> str:
    return sql(f"SELECT count(*) AS reads, CAST(sum(a.v) AS BIGINT) AS total FROM (SELECT {pos} AS pos FROM orders) s JOIN arr_price a ON a.i = s.pos", "arr_price")


@query(_pattern_sql("o_orderkey % (SELECT count(*) FROM arr_price)"))
def access_sequential(spark, sf):
    return _pattern(spark, sf, "sequential")


@query(_pattern_sql("o_orderkey * 17 % (SELECT count(*) FROM arr_price)"))
def access_strided(spark, sf):
    return _pattern(spark, sf, "strided", stride=17)


@query(_pattern_sql(f"{hash_sql('13', 'o_orderkey')} % (SELECT count(*) FROM arr_price)"))
def access_uniform(spark, sf):
    return _pattern(spark, sf, "uniform", seed=13)


@query(sql("SELECT s.slot, c.page * 8 AS pos FROM s JOIN c ON s.u >= c.lo / c.total AND s.u < c.hi / c.total", "arr_price",
           w="SELECT unnest(range((SELECT count(*) // 8 FROM arr_price))) AS page",
           r="SELECT page, pow(page + 1.0::DOUBLE, -1.8::DOUBLE) AS w, sum(pow(page + 1.0::DOUBLE, -1.8::DOUBLE)) OVER (ORDER BY page) AS hi FROM w",
           c="SELECT page, hi - w AS lo, hi, max(hi) OVER () AS total FROM r",
           s=f"SELECT o_orderkey AS slot, {uniform_sql('13', 'o_orderkey')} AS u FROM orders"))
def access_zipf(spark, sf):
    return sampling.access_pattern(_slots(spark, sf), fx.arr_price(spark, sf).count(), "zipf", seed=13, rows_per_page=8)


@query(sql("SELECT count(*) AS reads, CAST(sum(a.v) AS BIGINT) AS total FROM z JOIN arr_price a ON a.i = z.pos", "arr_price",
           w="SELECT unnest(range((SELECT count(*) // 8 FROM arr_price))) AS page",
           r="SELECT page, pow(page + 1.0::DOUBLE, -1.8::DOUBLE) AS w, sum(pow(page + 1.0::DOUBLE, -1.8::DOUBLE)) OVER (ORDER BY page) AS hi FROM w",
           c="SELECT page, hi - w AS lo, hi, max(hi) OVER () AS total FROM r",
           s=f"SELECT o_orderkey AS slot, {uniform_sql('13', 'o_orderkey')} AS u FROM orders",
           z="SELECT s.slot, c.page * 8 AS pos FROM s JOIN c ON s.u >= c.lo / c.total AND s.u < c.hi / c.total"))
def gather_sum(spark, sf):
    return _pattern(spark, sf, "zipf", seed=13, rows_per_page=8)


# Graph algorithms ---------------------------------------------------------------


def _root(spark, sf):
    """The part with the least id."""
    return fx.ids(spark, sf).orderBy("node_id").limit(1)


_BFS = ("@bfs(node_id, dist) USING KEY (node_id) AS (SELECT min(node_id), 0::BIGINT FROM ids UNION "
        "SELECT e.dst, min(b.dist + 1) FROM bfs b JOIN edges e ON e.src = b.node_id "
        "WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.node_id = e.dst) GROUP BY e.dst)")


@query(sql("SELECT (SELECT min(node_id) FROM ids) AS root, node_id, dist FROM bfs", "ids", "edges", recursive=True, bfs=_BFS))
def bfs(spark, sf):
    return algos.bfs(fx.edges(spark, sf), _root(spark, sf))


@query(sql("SELECT node_id, 'level ' || dist AS level FROM bfs WHERE dist <= 2", "ids", "edges", recursive=True, bfs=_BFS))
def bfs_bounded(spark, sf):
    out = algos.bfs(fx.edges(spark, sf), _root(spark, sf), max_depth=2)
    return out.select("node_id", F.concat(F.lit("level "), F.col("dist").cast("string")).alias("level"))


def _sssp_sql(weight: str, zero: str) -> str:
    return (f"@sp(node_id, dist) USING KEY (node_id) AS (SELECT min(node_id), {zero} FROM ids UNION "
            f"SELECT e.dst, min(b.dist + e.{weight}) AS d FROM sp b JOIN edges_w e ON e.src = b.node_id LEFT JOIN recurring.sp r ON r.node_id = e.dst "
            f"GROUP BY e.dst HAVING min(b.dist + e.{weight}) < coalesce(min(r.dist), 1e18))")


@query(sql("SELECT (SELECT min(node_id) FROM ids) AS root, node_id, dist FROM sp", "ids", "edges_w", recursive=True, sp=_sssp_sql("w", "0::BIGINT")))
def sssp(spark, sf):
    return algos.sssp(fx.edges_w(spark, sf), _root(spark, sf))


@query(sql("SELECT (SELECT min(node_id) FROM ids) AS root, node_id, round(dist, 6) AS dist FROM sp", "ids", "edges_w", recursive=True,
           sp=_sssp_sql("wf", "0::DOUBLE")))
def sssp_float(spark, sf):
    return algos.sssp(fx.edges_w(spark, sf), _root(spark, sf), "wf").withColumn("dist", F.round("dist", 6))


def _cc_sql(edges: str) -> dict[str, str]:
    return {
        "sym": f"SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}",
        "cc": ("@cc(node_id, comp) USING KEY (node_id) AS (SELECT src, src FROM sym UNION "
               "SELECT s.dst, min(c.comp) FROM cc c JOIN sym s ON s.src = c.node_id JOIN recurring.cc r ON r.node_id = s.dst "
               "GROUP BY s.dst HAVING min(c.comp) < min(r.comp))"),
    }


@query(sql("SELECT node_id, comp FROM cc", "edges", recursive=True, **_cc_sql("edges")))
def connected_components(spark, sf):
    return algos.connected_components(fx.edges(spark, sf))


@query(sql("SELECT node_id, comp FROM cc", "order_edges", recursive=True, **_cc_sql("order_edges")))
def connected_components_orders(spark, sf):
    """Customers with their orders: one component per buying customer."""
    return algos.connected_components(fx.order_edges(spark, sf))


@query(sql("SELECT comp, count(*) AS size FROM cc GROUP BY comp", "order_edges", recursive=True, **_cc_sql("order_edges")))
def component_summary(spark, sf):
    return stats.component_summary(algos.connected_components(fx.order_edges(spark, sf)))


@query(sql("SELECT count(*) AS components, max(size) AS largest, CAST(sum(size) AS BIGINT) AS nodes FROM (SELECT comp, count(*) AS size FROM cc GROUP BY comp)",
           "order_edges", recursive=True, **_cc_sql("order_edges")))
def component_count(spark, sf):
    return stats.component_count(algos.connected_components(fx.order_edges(spark, sf)))


def _rank_sql(deg: str, rounds: int) -> dict[str, str]:
    out = {"dg": f"SELECT i.node_id, greatest(count(e.src), 1) AS deg FROM ids i LEFT JOIN edges e ON e.{deg} = i.node_id GROUP BY 1",
           "nn": "SELECT count(*)::DOUBLE AS n FROM ids", "r0": "SELECT node_id, deg, 1.0::DOUBLE / n AS score FROM dg, nn"}
    for i in range(rounds):
        out[f"r{i + 1}"] = (
            f"SELECT d.node_id, d.deg, 0.15::DOUBLE / nn.n + 0.85::DOUBLE * coalesce(s.x, 0) AS score FROM dg d CROSS JOIN nn LEFT JOIN "
            f"(SELECT e.dst, sum(r.score / r.deg) AS x FROM edges e JOIN r{i} r ON r.node_id = e.src GROUP BY e.dst) s ON s.dst = d.node_id")
    return out


@query(sql("SELECT node_id, round(score, 6) AS score FROM r20", "ids", "edges", **_rank_sql("dst", 20)))
def pagerank(spark, sf):
    return algos.pagerank(fx.edges(spark, sf), fx.ids(spark, sf), k=20).withColumn("score", F.round("score", 6))


@query(sql("SELECT node_id, round(score, 6) AS score FROM r20", "ids", "edges", **_rank_sql("src", 20)))
def pagerank_out(spark, sf):
    out = algos.pagerank(fx.edges(spark, sf), fx.ids(spark, sf), k=20, norm="out", simple=True)
    return out.withColumn("score", F.round("score", 6))


def _typed_rank_sql(rounds: int) -> dict[str, str]:
    out = {"dg": "SELECT n.ntype, n.node_id, greatest(count(e.src), 1) AS deg FROM typed_nodes n LEFT JOIN typed_edges e "
                 "ON e.src_type = n.ntype AND e.src = n.node_id GROUP BY 1, 2",
           "nn": "SELECT count(*)::DOUBLE AS n FROM typed_nodes", "r0": "SELECT ntype, node_id, deg, 1.0::DOUBLE / n AS score FROM dg, nn"}
    for i in range(rounds):
        out[f"r{i + 1}"] = (
            f"SELECT d.ntype, d.node_id, d.deg, 0.15::DOUBLE / nn.n + 0.85::DOUBLE * coalesce(s.x, 0) AS score FROM dg d CROSS JOIN nn LEFT JOIN "
            f"(SELECT e.dst_type, e.dst, sum(r.score / r.deg) AS x FROM typed_edges e JOIN r{i} r ON r.ntype = e.src_type AND r.node_id = e.src "
            f"GROUP BY 1, 2) s ON s.dst_type = d.ntype AND s.dst = d.node_id")
    return out


@query(sql("SELECT ntype, node_id, round(score, 8) AS score FROM r5", "typed_nodes", "typed_edges", **_typed_rank_sql(5)))
def pagerank_hetero(spark, sf):
    out = algos.pagerank_hetero(fx.typed_edges(spark, sf), fx.typed_nodes(spark, sf), k=5)
    return out.withColumn("score", F.round("score", 8))


@query(sql("SELECT node_id, round(round(score, 9), 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, node_id) - 1 AS rank FROM r5", "ids", "edges",
           **_rank_sql("dst", 5)))
def rank_by_pagerank(spark, sf):
    """The pin list: all nodes by descending rank score."""
    ranked = algos.pagerank(fx.edges(spark, sf), fx.ids(spark, sf), k=5).withColumn("score", F.round("score", 9))
    return ordering.top_nodes(ranked, share=1.0).withColumn("score", F.round("score", 6))


