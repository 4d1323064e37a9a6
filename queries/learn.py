"""Message passing and graph-learning steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.operators import custom, message, softmax
from nodeloom.plans.store import materialize
from queries import fixtures as fx
from queries.fixtures import VECTOR_TEXT_SQL, sql, vector_text
from queries.graph import _blocks, sampled_ctes
from queries.relational import BATCH_SQL, train_batches

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH, HIDDEN, CLASSES = 64, 16, 10


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            SQL[fn.__name__] = oracle
        return fn

    return register


def weight(rows: int, cols: int, shift: int = 0) -> np.ndarray:
    """A fixed weight matrix by formula, the same in SQL."""
    i, j = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    return ((i * 7 + j * 13 + shift) % 17 - 8) / 40.0


def weight_sql(i: str, j: str, shift: int = 0) -> str:
    return f"((({i}) * 7 + ({j}) * 13 + {shift}) % 17 - 8) / 40.0::DOUBLE"


def bias(cols: int) -> np.ndarray:
    return (np.arange(cols) % 5 - 2) / 10.0


def bias_sql(j: str) -> str:
    return f"(({j}) % 5 - 2) / 10.0::DOUBLE"


# Scalar messages ----------------------------------------------------------------


def _vals(spark, sf):
    return fx.scores(spark, sf).withColumnRenamed("score", "val")


@query(sql("SELECT e.dst AS node_id, round(quantile_cont(score, 0.5), 6) AS median FROM edges e JOIN scores s ON s.node_id = e.src GROUP BY e.dst", "edges", "scores"))
def copy_u_median(spark, sf):
    return custom.quantile(fx.edges(spark, sf), _vals(spark, sf)).select("node_id", F.round("val", 6).alias("median"))


@query(sql("SELECT e.dst AS node_id, round(var_pop(score), 4) AS spread FROM edges e JOIN scores s ON s.node_id = e.src GROUP BY e.dst", "edges", "scores"))
def update_all_variance(spark, sf):
    """A reducer written by the user: the variance of the messages through states of three numbers."""
    out = custom.update_all(fx.edges(spark, sf), _vals(spark, sf), lambda v: v, custom.VARIANCE)
    return out.select("node_id", F.round("val", 4).alias("spread"))


@query(sql("SELECT e.dst AS node_id, CAST(sum(score) AS BIGINT) AS total, round(avg(score), 6) AS mean, max(score) AS top FROM edges e JOIN scores s "
           "ON s.node_id = e.src GROUP BY e.dst", "edges", "scores"))
def copy_u(spark: SparkSession, sf: str) -> DataFrame:
    e, v = fx.edges(spark, sf), _vals(spark, sf)
    out = message.copy_u(e, v, "sum").select("node_id", F.col("val").cast("bigint").alias("total"))
    out = out.join(message.copy_u(e, v, F.avg).select("node_id", F.round("val", 6).alias("mean")), "node_id")
    return out.join(message.copy_u(e, v, "max").withColumnRenamed("val", "top"), "node_id")


@query(sql("SELECT dst AS node_id, CAST(sum(w) AS BIGINT) AS total, max(w) AS top FROM edges_w GROUP BY dst", "edges_w"))
def copy_e(spark, sf):
    e = fx.edges_w(spark, sf)
    return message.copy_e(e, "w", "sum").withColumnRenamed("val", "total").join(
        message.copy_e(e, "w", "max").withColumnRenamed("val", "top"), "node_id")


@query(sql("SELECT 'e_div_u' AS op, e.src, e.dst, round(e.w / s.score * 1000, 6) AS val FROM edges_w e JOIN scores s ON s.node_id = e.src "
           "UNION ALL SELECT 'e_mul_v', e.src, e.dst, round(e.w * s.score * 1000, 6) FROM edges_w e JOIN scores s ON s.node_id = e.dst "
           "UNION ALL SELECT 'copy_v', e.src, e.dst, round(s.score * 1000, 6) FROM edges_w e JOIN scores s ON s.node_id = e.dst", "edges_w", "scores"))
def edge_op(spark, sf):
    e, v = fx.edges_w(spark, sf), _vals(spark, sf)
    parts = [message.edge_op(e, op, v).select(F.lit(op).alias("op"), "src", "dst", F.round(F.col("val") * 1000, 6).alias("val"))
             for op in ("e_div_u", "e_mul_v", "copy_v")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql("SELECT 'sum' AS cross_type, ntype, node_id, round(sum(v), 6) AS val FROM m GROUP BY 2, 3 "
           "UNION ALL SELECT 'mean', ntype, node_id, round(avg(v), 6) FROM m GROUP BY 2, 3", "typed_edges",
           twoway="SELECT * FROM typed_edges UNION ALL SELECT 'rev_' || etype, dst_type, dst, src_type, src FROM typed_edges",
           m="SELECT etype, dst_type AS ntype, dst AS node_id, avg(src % 97) AS v FROM twoway GROUP BY 1, 2, 3"))
def multi_update(spark, sf):
    e = fx.typed_edges(spark, sf)
    both = _both_ways(e)
    kinds = _both_ways(message.edge_kinds(e).withColumns({"src": F.lit(0), "dst": F.lit(0)})).collect()
    vals = fx.typed_nodes(spark, sf).withColumn("val", F.col("node_id") % 97)
    out = [message.multi_update(both, vals, "mean", cross, kinds).select(F.lit(cross).alias("cross_type"), "ntype", "node_id", F.round("val", 6).alias("val"))
           for cross in ("sum", "mean")]
    return out[0].unionByName(out[1])


def _both_ways(e: DataFrame) -> DataFrame:
    back = e.select(F.concat(F.lit("rev_"), "etype").alias("etype"), F.col("dst_type").alias("src_type"), F.col("dst").alias("src"),
                    F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
    return e.unionByName(back)


# Vector messages ----------------------------------------------------------------

_X = "SELECT node_id, generate_subscripts(feat, 1) - 1 AS dim, CAST(unnest(feat) AS DOUBLE) AS x FROM nodes"
_DIMS = "SELECT DISTINCT dim FROM x0"


def _mean_sql(x: str, edges: str = "edges") -> str:
    """Mean of the in-neighbours per (node, dim), 0 without any."""
    return (f"SELECT o.node_id, o.dim, coalesce(m.x, 0) AS x FROM {x} o LEFT JOIN (SELECT e.dst, f.dim, avg(f.x) AS x FROM {edges} e "
            f"JOIN {x} f ON f.node_id = e.src GROUP BY 1, 2) m ON m.dst = o.node_id AND m.dim = o.dim")


def _feats(spark, sf):
    return fx.nodes(spark, sf).select("node_id", "feat")


def _text(df: DataFrame, col: str = "neigh") -> DataFrame:
    return df.select("node_id", vector_text(col).alias("vec"))


_BY_NODE = f"SELECT node_id, {VECTOR_TEXT_SQL} AS vec FROM "


@query(sql(_BY_NODE + "m GROUP BY node_id", "nodes", "edges", x0=_X, m=_mean_sql("x0")))
def aggregate_mean(spark, sf):
    return _text(message.aggregate_mean(fx.edges(spark, sf), _feats(spark, sf)))


_WIDE = 16
_X_WIDE = f"SELECT node_id, dim + 64 * k AS dim, x * (k + 1) AS x FROM ({_X}) AS b, unnest(range(0, {_WIDE})) AS u(k)"


@query(sql(_BY_NODE + "m GROUP BY node_id", "nodes", "edges", x0=_X_WIDE, m=_mean_sql("x0")))
def aggregate_mean_wide(spark, sf):
    """The mean over 1,024 entries: the 64 given ones repeated with factors 1 to 16."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(_WIDE)), lambda k: F.transform("feat", lambda x: x.cast("double") * k))
    feats = _feats(spark, sf).select("node_id", F.flatten(parts).alias("feat"))
    return _text(message.aggregate_mean(fx.edges(spark, sf), feats))


_GCN = ("SELECT o.node_id, o.dim, coalesce(m.x, 0) AS x FROM {x} o LEFT JOIN (SELECT e.dst, f.dim, sum(f.x / sqrt(od.n * id.n)) AS x FROM edges e "
        "JOIN {x} f ON f.node_id = e.src JOIN od ON od.src = e.src JOIN id ON id.dst = e.dst GROUP BY 1, 2) m ON m.dst = o.node_id AND m.dim = o.dim")
_DEGS = {"od": "SELECT src, count(*)::DOUBLE AS n FROM edges GROUP BY src", "id": "SELECT dst, count(*)::DOUBLE AS n FROM edges GROUP BY dst"}


@query(sql(_BY_NODE + "m GROUP BY node_id", "nodes", "edges", x0=_X, **_DEGS, m=_GCN.format(x="x0")))
def aggregate_gcn(spark, sf):
    return _text(message.aggregate_gcn(fx.edges(spark, sf), _feats(spark, sf)))


@query(sql(_BY_NODE + "(SELECT node_id, dim, avg(x) AS x FROM (SELECT e.dst AS node_id, f.dim, f.x FROM edges e JOIN x0 f ON f.node_id = e.src "
           "UNION ALL SELECT node_id, dim, x FROM x0) GROUP BY 1, 2) GROUP BY node_id", "nodes", "edges", x0=_X))
def aggregate_sage_gcn(spark, sf):
    return _text(message.aggregate_sage_gcn(fx.edges(spark, sf), _feats(spark, sf)))


_SOFT = "SELECT src, dst, exp(w / 10.0::DOUBLE) / sum(exp(w / 10.0::DOUBLE)) OVER (PARTITION BY dst) AS a FROM edges_w"


@query(sql("SELECT src, dst, round(a, 6) AS alpha FROM soft", "edges_w", soft=_SOFT))
def edge_softmax(spark, sf):
    e = fx.edges_w(spark, sf).select("src", "dst", (F.col("w") / 10.0).alias("logit"))
    return message.edge_softmax(e).select("src", "dst", F.round("alpha_logit", 6).alias("alpha"))


def _project_sql(x: str, cols: int, shift: int) -> str:
    return (f"SELECT f.node_id, j.j AS dim, sum(f.x * ({weight_sql('f.dim', 'j.j', shift)})) AS x FROM {x} f, (SELECT unnest(range({cols})) AS j) j GROUP BY 1, 2")


_ATT = {
    "x0": _X, "z": _project_sql("x0", HIDDEN, 3),
    "sc": f"SELECT node_id, sum(x * ({weight_sql('0', 'dim', 1)})) AS el, sum(x * ({weight_sql('0', 'dim', 2)})) AS er FROM z GROUP BY node_id",
    "lg": "SELECT e.src, e.dst, CASE WHEN a.el + b.er >= 0 THEN a.el + b.er ELSE 0.2::DOUBLE * (a.el + b.er) END AS l FROM edges e "
          "JOIN sc a ON a.node_id = e.src JOIN sc b ON b.node_id = e.dst",
    "al": "SELECT src, dst, exp(l - max(l) OVER (PARTITION BY dst)) / sum(exp(l)) OVER (PARTITION BY dst) * exp(max(l) OVER (PARTITION BY dst)) AS a FROM lg",
    "att": "SELECT al.dst AS node_id, z.dim, sum(al.a * z.x) AS x FROM al JOIN z ON z.node_id = al.src GROUP BY 1, 2",
}


def _attention_weights() -> dict[str, np.ndarray]:
    return {"W": weight(WIDTH, HIDDEN, 3), "al": weight(1, HIDDEN, 1), "ar": weight(1, HIDDEN, 2)}


@query(sql(_BY_NODE + "att GROUP BY node_id", "nodes", "edges", **_ATT))
def aggregate_attention(spark, sf):
    w = _attention_weights()
    z = message.dense(_feats(spark, sf).withColumnRenamed("feat", "x"), {"x": w["W"]}, out="feat")
    z = message._heads_score(z, w["al"], w["ar"])
    return _text(message.aggregate_attention(fx.edges(spark, sf), z, 1))


@query(sql(f"SELECT node_id, {VECTOR_TEXT_SQL} AS vec FROM (SELECT node_id, dim, greatest(x + {bias_sql('dim')}, 0) AS x FROM p) GROUP BY node_id",
           "nodes", x0=_X, p=_project_sql("x0", CLASSES, 0)))
def dense(spark, sf):
    return _text(message.dense(_feats(spark, sf), {"feat": weight(WIDTH, CLASSES)}, bias(CLASSES), "relu"), "out")


def _argmax_sql(h: str) -> str:
    return f"SELECT node_id, CAST(arg_max(dim, x) AS BIGINT) AS prediction, {VECTOR_TEXT_SQL} AS vec FROM {h} GROUP BY node_id"


_SAGE = {
    "x0": _X, "m0": _mean_sql("x0"), "a0": _project_sql("x0", HIDDEN, 0), "b0": _project_sql("m0", HIDDEN, 5),
    "x1": f"SELECT a.node_id, a.dim, greatest(a.x + b.x + {bias_sql('a.dim')}, 0) AS x FROM a0 a JOIN b0 b USING (node_id, dim)",
    "m1": _mean_sql("x1"), "a1": _project_sql("x1", CLASSES, 2), "b1": _project_sql("m1", CLASSES, 7),
    "h": f"SELECT a.node_id, a.dim, a.x + b.x + {bias_sql('a.dim')} AS x FROM a1 a JOIN b1 b USING (node_id, dim)",
}


def _sage_weights() -> list[dict[str, np.ndarray]]:
    return [{"self": weight(WIDTH, HIDDEN, 0), "neigh": weight(WIDTH, HIDDEN, 5), "b": bias(HIDDEN)},
            {"self": weight(HIDDEN, CLASSES, 2), "neigh": weight(HIDDEN, CLASSES, 7), "b": bias(CLASSES)}]


@query(sql(_argmax_sql("h"), "nodes", "edges", **_SAGE))
def gnn_infer_sage(spark, sf):
    e = fx.edges(spark, sf)
    out = message.gnn_infer([e, e], _feats(spark, sf), _sage_weights(), "sage")
    return out.select("node_id", "prediction", vector_text("logits").alias("vec"))


_GCN2 = {
    "x0": _X, **_DEGS, "m0": _GCN.format(x="x0"), "b0": _project_sql("m0", HIDDEN, 0),
    "x1": f"SELECT node_id, dim, greatest(x + {bias_sql('dim')}, 0) AS x FROM b0",
    "m1": _GCN.format(x="x1"), "b1": _project_sql("m1", CLASSES, 2), "h": f"SELECT node_id, dim, x + {bias_sql('dim')} AS x FROM b1",
}


@query(sql(_argmax_sql("h"), "nodes", "edges", **_GCN2))
def gnn_infer_gcn(spark, sf):
    e = fx.edges(spark, sf)
    w = [{"W": weight(WIDTH, HIDDEN, 0), "b": bias(HIDDEN)}, {"W": weight(HIDDEN, CLASSES, 2), "b": bias(CLASSES)}]
    out = message.gnn_infer([e, e], _feats(spark, sf), w, "gcn")
    return out.select("node_id", "prediction", vector_text("logits").alias("vec"))


def _gat_ctes(tag: str, x: str, cols: int, shifts: tuple[int, int, int], heads: int = 2) -> dict[str, str]:
    """Attention over ``edges``: ``att<tag>`` has the weighted sum per (node, dim), 0 without in-edges."""
    w, d = shifts[0], cols // heads
    score = lambda s: f"sum(x * ({weight_sql(f'dim // {d}', f'dim % {d}', s)}))"
    return {
        f"z{tag}": _project_sql(x, cols, w),
        f"sc{tag}": f"SELECT node_id, dim // {d} AS head, {score(shifts[1])} AS el, {score(shifts[2])} AS er FROM z{tag} GROUP BY ALL",
        f"lg{tag}": f"SELECT e.src, e.dst, a.head, CASE WHEN a.el + b.er >= 0 THEN a.el + b.er ELSE 0.2::DOUBLE * (a.el + b.er) END AS l FROM edges e "
                    f"JOIN sc{tag} a ON a.node_id = e.src JOIN sc{tag} b ON b.node_id = e.dst AND b.head = a.head",
        f"pr{tag}": f"SELECT src, dst, head, exp(l - max(l) OVER (PARTITION BY dst, head)) AS p FROM lg{tag}",
        f"al{tag}": f"SELECT src, dst, head, p / sum(p) OVER (PARTITION BY dst, head) AS a FROM pr{tag}",
        f"att{tag}": f"SELECT o.node_id, o.dim, coalesce(m.x, 0) AS x FROM z{tag} o LEFT JOIN (SELECT al.dst, z.dim, sum(al.a * z.x) AS x FROM al{tag} al "
                     f"JOIN z{tag} z ON z.node_id = al.src AND z.dim // {d} = al.head GROUP BY ALL) m ON m.dst = o.node_id AND m.dim = o.dim",
    }


_GAT = {
    "x0": _X, **_gat_ctes("0", "x0", HIDDEN, (0, 1, 2)), "x1": f"SELECT node_id, dim, greatest(x + {bias_sql('dim')}, 0) AS x FROM att0",
    **_gat_ctes("1", "x1", 2 * CLASSES, (3, 4, 5)),
    "h": f"SELECT node_id, dim % {CLASSES} AS dim, avg(x + {bias_sql('dim')}) AS x FROM att1 GROUP BY ALL",
}


@query(sql(_argmax_sql("h"), "nodes", "edges", **_GAT))
def gnn_infer_gat(spark, sf):
    """Two attention layers with two heads over the whole graph."""
    e = fx.edges(spark, sf)
    half = HIDDEN // 2
    w = [{"W": weight(WIDTH, HIDDEN), "al": weight(2, half, 1), "ar": weight(2, half, 2), "b": bias(HIDDEN)},
         {"W": weight(HIDDEN, 2 * CLASSES, 3), "al": weight(2, CLASSES, 4), "ar": weight(2, CLASSES, 5), "b": bias(2 * CLASSES)}]
    out = message.gnn_infer([e, e], _feats(spark, sf), w, "gat")
    return out.select("node_id", "prediction", vector_text("logits").alias("vec"))


_BLOCKS = sampled_ctes(BATCH_SQL, [4, 3], 5)


def _block_mean(x: str, block: str) -> str:
    return (f"SELECT o.batch_id, o.node_id, o.dim, coalesce(m.x, 0) AS x FROM {x} o LEFT JOIN (SELECT e.batch_id, e.dst, f.dim, avg(f.x) AS x FROM {block} e "
            f"JOIN {x} f ON f.node_id = e.src AND f.batch_id = e.batch_id GROUP BY ALL) m ON m.batch_id = o.batch_id AND m.dst = o.node_id AND m.dim = o.dim")


def _block_project(x: str, cols: int, shift: int) -> str:
    return (f"SELECT f.batch_id, f.node_id, j.j AS dim, sum(f.x * ({weight_sql('f.dim', 'j.j', shift)})) AS x FROM {x} f, "
            f"(SELECT unnest(range({cols})) AS j) j GROUP BY ALL")


@query(sql(f"SELECT batch_id, node_id, CAST(arg_max(dim, x) AS BIGINT) AS prediction, {VECTOR_TEXT_SQL} AS vec FROM h JOIN fr2 USING (batch_id, node_id) GROUP BY 1, 2",
           "nodes", "edges", **_BLOCKS, x0=_X, y0="SELECT f.batch_id, x0.* FROM fr0 f JOIN x0 USING (node_id)",
           m0=_block_mean("y0", "blk0"), a0=_block_project("y0", HIDDEN, 0), b0=_block_project("m0", HIDDEN, 5),
           y1=f"SELECT a.batch_id, a.node_id, a.dim, greatest(a.x + b.x + {bias_sql('a.dim')}, 0) AS x FROM a0 a JOIN b0 b USING (batch_id, node_id, dim) "
              "JOIN fr1 USING (batch_id, node_id)",
           m1=_block_mean("y1", "blk1"), a1=_block_project("y1", CLASSES, 2), b1=_block_project("m1", CLASSES, 7),
           h=f"SELECT a.batch_id, a.node_id, a.dim, a.x + b.x + {bias_sql('a.dim')} AS x FROM a1 a JOIN b1 b USING (batch_id, node_id, dim)"))
def gnn_infer_sampled(spark, sf):
    """SAGE over the sampled blocks of every training batch."""
    blocks, inputs = _blocks(spark, sf)
    feat = inputs.join(_feats(spark, sf), "node_id")
    per_layer = [blocks.filter(F.col("layer") == i).select("batch_id", "src", "dst") for i in (0, 1)]
    seeds = train_batches(spark, sf).select("batch_id", "node_id")
    out = message.gnn_infer(per_layer, feat, _sage_weights(), "sage", seeds, by=["batch_id"])
    return out.select("batch_id", "node_id", "prediction", vector_text("logits").alias("vec"))


# Relational layers --------------------------------------------------------------


def _relational(spark, sf, kind):
    """Orders predicted from customers, parts and suppliers through edges in both directions."""
    e = fx.typed_edges(spark, sf)
    back = e.select(F.concat(F.lit("rev_"), "etype").alias("etype"), F.col("dst_type").alias("src_type"), F.col("dst").alias("src"),
                    F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
    both = e.unionByName(back)
    n = fx.table(spark, sf, "embeddings").count()
    vec = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("feat"))
    feat = fx.typed_nodes(spark, sf).withColumn("vec_id", F.col("node_id") % F.lit(n)).join(vec, "vec_id").select("ntype", "node_id", "feat")
    etypes = ["placed", "contains", "supplied_by", "rev_placed", "rev_contains", "rev_supplied_by"]
    if kind == "rgat":
        half = HIDDEN // 2
        layer = lambda rows, i: {"W": weight(rows, HIDDEN, i), "al": weight(2, half, i + 1), "ar": weight(2, half, i + 2)}
    else:
        layer = lambda rows, i: {"W": weight(rows, HIDDEN, i), "b": bias(HIDDEN)}
    weights = [{t: layer(rows, i) for i, t in enumerate(etypes)} for rows in (WIDTH, HIDDEN)]
    out = message.gnn_infer_hetero(both, feat, weights, kind, (weight(HIDDEN, CLASSES, 4), bias(CLASSES)), "orders")
    return out.select("node_id", "prediction", vector_text("logits").alias("vec"))


def _relational_sql() -> str:
    """Mean over edge types of normalised sums; a node gets one term per edge type into its type."""
    etypes = ["placed", "contains", "supplied_by", "rev_placed", "rev_contains", "rev_supplied_by"]
    kinds = " UNION ALL ".join(f"SELECT '{t}' AS etype, {i} AS shift" for i, t in enumerate(etypes))
    ctes = {
        "twoway": "SELECT * FROM typed_edges UNION ALL SELECT 'rev_' || etype, dst_type, dst, src_type, src FROM typed_edges",
        "kinds": f"SELECT k.etype, k.shift, b.dst_type FROM ({kinds}) k JOIN (SELECT DISTINCT etype, dst_type FROM twoway) b USING (etype)",
        "od": "SELECT etype, src, count(*)::DOUBLE AS n FROM twoway GROUP BY ALL", "id": "SELECT etype, dst, count(*)::DOUBLE AS n FROM twoway GROUP BY ALL",
        "x0": "SELECT n.ntype, n.node_id, generate_subscripts(e.embedding, 1) - 1 AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS x FROM typed_nodes n "
              "JOIN embeddings e ON e.vec_id = n.node_id % (SELECT count(*) FROM embeddings)",
    }
    for layer in (0, 1):
        # Projection commutes with the sum, so rows are projected before they travel.
        ctes[f"p{layer}"] = (f"SELECT k.etype, f.node_id, j.j AS dim, sum(f.x * ({weight_sql('f.dim', 'j.j', 0).replace(') % 17', '+ k.shift) % 17')})) AS x "
                             f"FROM x{layer} f JOIN (SELECT DISTINCT b.etype, b.src_type, k.shift FROM twoway b JOIN kinds k USING (etype)) k ON k.src_type = f.ntype, "
                             f"(SELECT unnest(range({HIDDEN})) AS j) j GROUP BY ALL")
        ctes[f"s{layer}"] = (f"SELECT b.etype, b.dst, p.dim, sum(p.x / sqrt(od.n * id.n)) AS x FROM twoway b JOIN p{layer} p ON p.etype = b.etype AND p.node_id = b.src "
                             "JOIN od ON od.etype = b.etype AND od.src = b.src JOIN id ON id.etype = b.etype AND id.dst = b.dst GROUP BY ALL")
        relu = "greatest(avg(x), 0)" if layer == 0 else "avg(x)"
        ctes[f"x{layer + 1}"] = (f"SELECT ntype, node_id, dim, {relu} AS x FROM (SELECT n.ntype, n.node_id, k.etype, d.dim, "
                                 f"coalesce(s.x, 0) + {bias_sql('d.dim')} AS x FROM typed_nodes n JOIN kinds k ON k.dst_type = n.ntype "
                                 f"CROSS JOIN (SELECT unnest(range({HIDDEN})) AS dim) d LEFT JOIN s{layer} s ON s.etype = k.etype AND s.dst = n.node_id AND s.dim = d.dim) "
                                 "GROUP BY ALL")
    ctes["t"] = "SELECT node_id, dim, x FROM x2 WHERE ntype = 'orders'"
    ctes["q"] = _project_sql("t", CLASSES, 4)
    ctes["h"] = f"SELECT node_id, dim, x + {bias_sql('dim')} AS x FROM q"
    return sql(_argmax_sql("h"), "typed_nodes", "typed_edges", **ctes)


@query(_relational_sql())
def gnn_infer_rgcn(spark, sf):
    return _relational(spark, sf, "rgcn")


def _relational_sum_sql(kind: str) -> str:
    """``rsage`` and ``rgat``: terms per edge type into a node's type, added up."""
    etypes = ["placed", "contains", "supplied_by", "rev_placed", "rev_contains", "rev_supplied_by"]
    kinds = " UNION ALL ".join(f"SELECT '{t}' AS etype, {i} AS shift" for i, t in enumerate(etypes))
    half = HIDDEN // 2
    project = weight_sql("f.dim", "j.j", 0).replace(") % 17", "+ k.shift) % 17")
    score = lambda add: weight_sql(f"dim // {half}", f"dim % {half}", add).replace(") % 17", "+ shift) % 17")
    ctes = {
        "twoway": "SELECT * FROM typed_edges UNION ALL SELECT 'rev_' || etype, dst_type, dst, src_type, src FROM typed_edges",
        "kinds": f"SELECT k.etype, k.shift, b.src_type, b.dst_type FROM ({kinds}) k JOIN (SELECT DISTINCT etype, src_type, dst_type FROM twoway) b USING (etype)",
        "x0": "SELECT n.ntype, n.node_id, generate_subscripts(e.embedding, 1) - 1 AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS x FROM typed_nodes n "
              "JOIN embeddings e ON e.vec_id = n.node_id % (SELECT count(*) FROM embeddings)",
    }
    for n in (0, 1):
        for side in ("src", "dst"):
            ctes[f"{side}{n}"] = (f"SELECT k.etype, k.shift, f.node_id, j.j AS dim, sum(f.x * ({project})) AS x FROM x{n} f JOIN kinds k ON k.{side}_type = f.ntype, "
                                  f"(SELECT unnest(range({HIDDEN})) AS j) j GROUP BY ALL")
        if kind == "rsage":
            ctes[f"t{n}"] = (f"SELECT etype, node_id, dim, avg(x) + {bias_sql('dim')} AS x FROM (SELECT b.etype, b.dst AS node_id, p.dim, p.x FROM twoway b "
                             f"JOIN src{n} p ON p.etype = b.etype AND p.node_id = b.src UNION ALL SELECT etype, node_id, dim, x FROM dst{n}) GROUP BY etype, node_id, dim")
        else:
            ctes[f"el{n}"] = f"SELECT etype, node_id, dim // {half} AS head, sum(x * ({score(1)})) AS s FROM src{n} GROUP BY ALL"
            ctes[f"er{n}"] = f"SELECT etype, node_id, dim // {half} AS head, sum(x * ({score(2)})) AS s FROM dst{n} GROUP BY ALL"
            ctes[f"lg{n}"] = (f"SELECT b.etype, b.src, b.dst, u.head, CASE WHEN u.s + v.s >= 0 THEN u.s + v.s ELSE 0.2::DOUBLE * (u.s + v.s) END AS l FROM twoway b "
                              f"JOIN el{n} u ON u.etype = b.etype AND u.node_id = b.src JOIN er{n} v ON v.etype = b.etype AND v.node_id = b.dst AND v.head = u.head")
            ctes[f"pr{n}"] = f"SELECT etype, src, dst, head, exp(l - max(l) OVER (PARTITION BY etype, dst, head)) AS p FROM lg{n}"
            ctes[f"al{n}"] = f"SELECT etype, src, dst, head, p / sum(p) OVER (PARTITION BY etype, dst, head) AS a FROM pr{n}"
            ctes[f"at{n}"] = (f"SELECT a.etype, a.dst AS node_id, z.dim, sum(a.a * z.x) AS x FROM al{n} a JOIN src{n} z ON z.etype = a.etype AND z.node_id = a.src "
                              f"AND z.dim // {half} = a.head GROUP BY ALL")
            ctes[f"t{n}"] = (f"SELECT d.etype, d.node_id, d.dim, coalesce(m.x, 0) AS x FROM dst{n} d LEFT JOIN at{n} m ON m.etype = d.etype AND m.node_id = d.node_id "
                             "AND m.dim = d.dim")
        total = "greatest(sum(t.x), 0)" if n == 0 else "sum(t.x)"
        ctes[f"x{n + 1}"] = f"SELECT k.dst_type AS ntype, t.node_id, t.dim, {total} AS x FROM t{n} t JOIN kinds k USING (etype) GROUP BY ALL"
    ctes["t"] = "SELECT node_id, dim, x FROM x2 WHERE ntype = 'orders'"
    ctes["q"] = _project_sql("t", CLASSES, 4)
    ctes["h"] = f"SELECT node_id, dim, x + {bias_sql('dim')} AS x FROM q"
    return sql(_argmax_sql("h"), "typed_nodes", "typed_edges", **ctes)


@query(_relational_sum_sql("rsage"))
def gnn_infer_rsage(spark, sf):
    return _relational(spark, sf, "rsage")


@query(_relational_sum_sql("rgat"))
def gnn_infer_rgat(spark, sf):
    return _relational(spark, sf, "rgat")


# Propagated features and the classifier -----------------------------------------


@query(sql(f"SELECT node_id, 0::BIGINT AS hop, {VECTOR_TEXT_SQL} AS vec FROM x0 GROUP BY node_id UNION ALL "
           f"SELECT node_id, 1, {VECTOR_TEXT_SQL} FROM m0 GROUP BY node_id UNION ALL SELECT node_id, 2, {VECTOR_TEXT_SQL} FROM m1 GROUP BY node_id",
           "nodes", "edges", x0=_X, m0=_mean_sql("x0"), m1=_mean_sql("m0")))
def propagate_features(spark, sf):
    out = message.propagate_features(fx.edges(spark, sf), _feats(spark, sf), 2)
    return out.select("node_id", "hop", vector_text("feat").alias("vec"))


STEPS, RATE, REG = 4, 4.0, 0.01


def _softmax_sql() -> dict[str, str]:
    """The same gradient steps as CTEs; the bias is the feature after the last one."""
    ctes = {
        "x0": _X, "m0": _mean_sql("x0"),
        "xs": f"SELECT node_id, dim, x FROM x0 UNION ALL SELECT node_id, dim + {WIDTH}, x FROM m0 UNION ALL SELECT node_id, {2 * WIDTH}, 1::DOUBLE FROM nodes",
        "tr": "SELECT node_id, label FROM nodes WHERE split = 'train' AND label IS NOT NULL",
        "w0": f"SELECT c, dim, 0::DOUBLE AS w FROM (SELECT unnest(range({CLASSES})) AS c), (SELECT unnest(range({2 * WIDTH + 1})) AS dim)",
    }
    for i in range(STEPS):
        ctes |= {
            f"z{i}": f"SELECT t.node_id, t.label, w.c, sum(x.x * w.w) AS z FROM tr t JOIN xs x USING (node_id) JOIN w{i} w USING (dim) GROUP BY 1, 2, 3",
            f"e{i}": f"SELECT node_id, label, c, exp(z - max(z) OVER (PARTITION BY node_id)) AS e FROM z{i}",
            f"p{i}": f"SELECT node_id, c, e / sum(e) OVER (PARTITION BY node_id) - CASE WHEN c = label THEN 1 ELSE 0 END AS p FROM e{i}",
            f"g{i}": f"SELECT p.c, x.dim, sum(p.p * x.x) / (SELECT count(*) FROM tr) AS g FROM p{i} p JOIN xs x USING (node_id) GROUP BY 1, 2",
            f"w{i + 1}": f"SELECT c, dim, w - {RATE}::DOUBLE * (coalesce(g, 0) + {REG}::DOUBLE * w) AS w FROM w{i} LEFT JOIN g{i} USING (c, dim)",
        }
    ctes["pr"] = (f"SELECT node_id, arg_min(c, (-z, c)) AS prediction FROM (SELECT x.node_id, w.c, sum(x.x * w.w) AS z FROM xs x JOIN w{STEPS} w USING (dim) "
                  "GROUP BY 1, 2) GROUP BY node_id")
    return ctes


def _fitted(spark, sf):
    """The model and the table (node_id, features) of the vectors and their neighbours' means side by side."""
    hops = message.propagate_features(fx.edges(spark, sf), _feats(spark, sf), 1)
    table = materialize(message.stack_hops(hops), "train")
    labels = fx.nodes(spark, sf).filter("split = 'train'").select("node_id", "label")
    return softmax.fit(table, labels, CLASSES, steps=STEPS, rate=RATE, reg=REG), table


@query(sql(f"SELECT c AS class, dim AS feature, round(w, 6) AS weight FROM w{STEPS}", "nodes", "edges", **_softmax_sql()))
def train_classifier(spark, sf):
    """The weights after a fixed number of full gradient steps."""
    model, _ = _fitted(spark, sf)
    return softmax.weight_table(model, spark).withColumn("weight", F.round("weight", 6))


@query(sql("SELECT split, count(*) AS n, sum(CASE WHEN prediction = label THEN 1 ELSE 0 END)::BIGINT AS hits FROM pr JOIN nodes USING (node_id) "
           "WHERE label IS NOT NULL GROUP BY split", "nodes", "edges", **_softmax_sql()))
def classifier_hits(spark, sf):
    """Right predictions per split."""
    model, table = _fitted(spark, sf)
    rows = softmax.predict(model, table).join(fx.nodes(spark, sf).filter("label IS NOT NULL").select("node_id", "label", "split"), "node_id")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("hits"))


@query(sql("SELECT round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy, count(*) AS n FROM pr JOIN nodes USING (node_id) "
           "WHERE label IS NOT NULL AND split = 'test'", "nodes", "edges", **_softmax_sql()))
def evaluate_classifier(spark, sf):
    model, table = _fitted(spark, sf)
    return softmax.evaluate(model, table, fx.nodes(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))
