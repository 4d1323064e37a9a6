"""Message passing as joins and aggregations, and the data steps of graph learning.

Vectors are ``array<float|double>`` columns. Sums and means of vectors are combined inside each
task first: a hub sends one partial vector per task.
``by`` names extra key columns (for example ``batch_id``) that separate independent graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nodeloom.operators import neighbours
from nodeloom.operators.stats import accuracy
from nodeloom.plans.skew import shuffled
from nodeloom.plans.store import materialize, save, save_last

Reducer = str | Callable[[Column], Column]
_REDUCERS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def _reducer(reduce: Reducer) -> Callable[[Column], Column]:
    return _REDUCERS[reduce] if isinstance(reduce, str) else reduce


def copy_u(edges: DataFrame, node_val: DataFrame, reduce: Reducer = "sum") -> DataFrame:
    """(node_id, val): source values reduced per destination; ``reduce`` may be an aggregate factory."""
    sent = edges.join(node_val.select(F.col("node_id").alias("src"), "val"), "src")
    return sent.groupBy(F.col("dst").alias("node_id")).agg(_reducer(reduce)(F.col("val")).alias("val"))


def copy_e(edges: DataFrame, weight: str = "w", reduce: Reducer = "sum") -> DataFrame:
    """(node_id, val): edge values reduced per destination."""
    return edges.groupBy(F.col("dst").alias("node_id")).agg(_reducer(reduce)(F.col(weight)).alias("val"))


def edge_op(edges: DataFrame, op: str, node_val: DataFrame, weight: str = "w") -> DataFrame:
    """(src, dst, val) for ``e_div_u``, ``e_mul_v``, ``e_mul_u``, ``e_div_v``, ``copy_v`` or ``copy_u``."""
    verb, end = op.rsplit("_", 1)
    key = {"u": "src", "v": "dst"}[end]
    joined = edges.join(node_val.select(F.col("node_id").alias(key), "val"), key)
    if verb == "copy":
        out = F.col("val")
    else:
        e = F.col(weight)
        out = {"e_div": e / F.col("val"), "e_mul": e * F.col("val")}[verb]
    return joined.select("src", "dst", out.alias("val"))


def _coded(col: str, values: Sequence) -> Column:
    """The place of a column's value in ``values``, null for any other."""
    return fold(lambda rest, i: F.when(F.col(col).eqNullSafe(F.lit(values[i])), F.lit(i)).otherwise(rest),
                range(len(values)), F.lit(None).cast("int"))


def edge_kinds(typed_edges: DataFrame) -> DataFrame:
    """(etype, src_type, dst_type), one row per edge type."""
    return typed_edges.select("etype", "src_type", "dst_type").distinct()


def multi_update(typed_edges: DataFrame, node_val: DataFrame, reduce: Reducer = "sum",
                 cross: str = "sum", kinds: Sequence[Row] | None = None) -> DataFrame:
    """(ntype, node_id, val): reduction per edge type, then across edge types.

    Types travel as small numbers: their names would be most of what is shuffled, sorted and compared per edge.
    ``kinds`` are the rows of :func:`edge_kinds`, if they are known.
    """
    kinds = edge_kinds(typed_edges).collect() if kinds is None else kinds
    text = lambda x: (x is not None, x)
    etypes, starts, ends = (sorted({r[c] for r in kinds}, key=text) for c in ("etype", "src_type", "dst_type"))
    starts = [s for s in starts if s is not None]
    coded = typed_edges.select(_coded("etype", etypes).alias("_e"), _coded("src_type", starts).alias("_s"), "src",
                               _coded("dst_type", ends).alias("_d"), F.col("dst").alias("node_id")).filter("_s IS NOT NULL")
    vals = node_val.select(_coded("ntype", starts).alias("_s"), F.col("node_id").alias("src"), "val").filter("_s IS NOT NULL")
    per_type = coded.join(vals, ["src", "_s"]).groupBy("_e", "_d", "node_id").agg(_reducer(reduce)(F.col("val")).alias("val"))
    out = per_type.groupBy("_d", "node_id").agg(_reducer(cross)(F.col("val")).alias("val"))
    name = fold(lambda rest, i: F.when(F.col("_d") == i, F.lit(ends[i])).otherwise(rest), range(len(ends)), F.lit(None).cast("string"))
    return out.select(name.alias("ntype"), "node_id", "val")


# Vector aggregation -------------------------------------------------------------


def _vector(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


#: Widths up to this are summed as columns of generated code, which takes at most 100 fields in one
#: pass. Per row that is up to ten times faster than a buffer object; at 1,024 entries the buffer is.
COLUMNS = 96


def _width(df: DataFrame, col: str) -> int:
    """Entries of the vectors of a table, read from one row; 0 for an empty table."""
    row = df.filter(F.col(col).isNotNull()).select(F.size(col).alias("k")).first()
    return row["k"] if row else 0


def _vector_sum(df: DataFrame, keys: Sequence[str | Column], col: str, width: int, metric: str = "sum") -> DataFrame:
    """Element-wise sum or mean per key as ``_out``, with one exchange for every width.

    Whole vectors are combined inside each task before the exchange: narrow ones as one column per
    entry, wide ones in a typed buffer. Null vectors are left out; one of another width is an error.
    """
    keyed = df.select(*keys, F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    names = keyed.columns[:-1]
    fits = F.when(F.size("_v") == width, F.col("_v")).otherwise(F.raise_error(F.lit(f"a vector has not {width} entries")))
    if width > COLUMNS:
        whole = array_to_vector(fits.cast("array<double>"))
        total = Summarizer.mean(whole) if metric == "mean" else Summarizer.sum(whole)
        return keyed.groupBy(*names).agg(total.alias("_out")).select(*names, vector_to_array("_out").alias("_out"))
    rows = keyed.withColumn("_v", fits)
    sums = rows.groupBy(*names).agg(
        *[F.sum(F.get("_v", F.lit(j)).cast("double")).alias(f"_c{j}") for j in range(width)], F.count(F.lit(1)).alias("_n"))
    entries = [F.col(f"_c{j}") / F.col("_n") if metric == "mean" else F.col(f"_c{j}") for j in range(width)]
    return sums.select(*names, F.array(*entries).cast("array<double>").alias("_out"))


def _send(edges: DataFrame, feat: DataFrame, by: Sequence[str]) -> DataFrame:
    return edges.join(shuffled(feat.select(*by, F.col("node_id").alias("src"), "feat")), [*by, "src"])


def _zeros_like(col: str) -> Column:
    return F.transform(F.col(col), lambda _: F.lit(0.0))


def aggregate_mean(edges: DataFrame, feat: DataFrame, nodes: DataFrame | None = None,
                   by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """(node_id, feat, neigh): own vector and the mean of the in-neighbours', 0 without any.

    ``nodes`` limits the output to the destinations asked for. ``width``, here and below, is the length
    of the vectors; without it, it is read from one row.
    """
    by = list(by)
    width = _width(feat, "feat") if width is None else width
    if width > COLUMNS and not by and neighbours.countable(edges):
        means = neighbours.mean_wide(edges, feat, width)
    else:
        means = _vector_sum(_send(edges, feat, by), [*by, F.col("dst").alias("node_id")], "feat", width, "mean")
    own = feat if nodes is None else feat.join(nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi")
    # The length stands beside the own vector, so that a reader of the means alone does not move it.
    own = own.select(*by, "node_id", "feat", F.when(F.col("feat").isNotNull(), F.size("feat")).alias("_k"))
    joined = own.join(shuffled(means), [*by, "node_id"], "left")
    return joined.select(*by, "node_id", "feat", F.coalesce("_out", F.array_repeat(F.lit(0.0), F.col("_k"))).alias("neigh"))


def _into_sums(edges: DataFrame, feat: DataFrame, width: int, own: DataFrame | None = None) -> DataFrame:
    """(node_id, _out, _n): sums of the in-neighbours' vectors and their count, with the rows ``own`` (node_id, feat) among them.

    With ``own`` only the destinations that it has are kept.
    """
    how = neighbours.deal(edges, width) if neighbours.countable(edges) and width + 2 <= COLUMNS else neighbours.Deal()
    if how.shards or how.blocks:
        rows = neighbours.partial_sums(edges, feat, width, how).select("node_id", F.col("_v").alias("_p"))
    else:
        sent = _send(edges, feat, []).filter(F.col("feat").isNotNull())
        rows = sent.select(F.col("dst").alias("node_id"), F.concat(F.col("feat").cast("array<double>"), F.array(F.lit(1.0))).alias("_p"))
    if own is not None:
        mark = lambda col, *ends: F.concat(col, F.array(*[F.lit(e) for e in ends]))
        rows = rows.select("node_id", mark(F.col("_p"), 0.0).alias("_p")).unionByName(
            own.filter(F.col("feat").isNotNull()).select("node_id", mark(F.col("feat").cast("array<double>"), 1.0, 1.0).alias("_p")))
    sums = _vector_sum(rows, ["node_id"], "_p", width + (1 if own is None else 2))
    if own is not None:
        sums = sums.filter(F.element_at("_out", -1) > 0)
    return sums.select("node_id", F.slice("_out", 1, width).alias("_out"), F.element_at("_out", width + 1).alias("_n"))


def aggregate_gcn(edges: DataFrame, feat: DataFrame, nodes: DataFrame | None = None,
                  by: Sequence[str] = (), width: int | None = None, into: DataFrame | None = None) -> DataFrame:
    """(node_id, neigh): sum of feat[u] / sqrt(outdeg(u) * indeg(v)), degrees at least 1.

    ``into`` (node_id), here and below, has the destinations when they are not in ``feat``; it goes without ``nodes`` and ``by``.
    """
    by = list(by)
    width = _width(feat, "feat") if width is None else width
    out_deg = edges.groupBy(*by, "src").agg(F.count(F.lit(1)).alias("_od"))
    in_deg = edges.groupBy(*by, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("_id"))
    # The degree goes onto the node table, so the edges are joined once, against a written table.
    norm = F.sqrt(F.col("_od").cast("double"))
    scaled = feat.join(out_deg.withColumnRenamed("src", "node_id"), [*by, "node_id"])
    scaled = scaled.select(*by, "node_id", F.transform("feat", lambda x: x / norm).alias("feat"))
    if into is None:
        sums = _vector_sum(_send(edges, materialize(scaled, "scaled"), by), [*by, F.col("dst").alias("node_id")], "feat", width)
    else:
        sums = _into_sums(edges, scaled, width)
    sums = sums.join(in_deg, [*by, "node_id"]).withColumn("_n", F.sqrt(F.col("_id").cast("double")))
    sums = sums.select(*by, "node_id", F.transform("_out", lambda x: x / F.col("_n")).alias("_out"))
    own = feat if nodes is None else feat.join(nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi")
    # Of the own vectors only the length is needed.
    size = F.when(F.col("feat").isNotNull(), F.size("feat"))
    own = own.select(*by, "node_id", size.alias("_k")) if into is None else into.select("node_id", F.lit(width).alias("_k"))
    joined = own.join(sums, [*by, "node_id"], "left")
    return joined.select(*by, "node_id", F.coalesce("_out", F.array_repeat(F.lit(0.0), F.col("_k"))).alias("neigh"))


def aggregate_sage_gcn(edges: DataFrame, feat: DataFrame, nodes: DataFrame | None = None,
                       by: Sequence[str] = (), width: int | None = None, into: DataFrame | None = None) -> DataFrame:
    """(node_id, neigh): (sum of neighbours + self) / (indegree + 1). ``into`` has the vectors of the destinations, too."""
    by = list(by)
    width = _width(feat, "feat") if width is None else width
    if into is not None:
        sums = _into_sums(edges, feat, width, into)
        return sums.select("node_id", F.transform("_out", lambda x: x / F.col("_n")).alias("neigh"))
    own = feat if nodes is None else feat.join(nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi")
    sent = _send(edges, feat, by).select(*by, F.col("dst").alias("node_id"), "feat")
    if nodes is not None:
        sent = sent.join(nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi")
    rows = sent.unionByName(own.select(*by, "node_id", "feat"))
    return _vector_sum(rows, [*by, "node_id"], "feat", width, "mean").withColumnRenamed("_out", "neigh")


def edge_softmax(edges: DataFrame, logits: Sequence[str] = ("logit",), by: Sequence[str] = ()) -> DataFrame:
    """Adds one ``alpha_<logit>`` per logit column: softmax over the edges entering each dst.

    Maxima and sums per dst are aggregated (combined inside each task first) and written before they
    are joined back: a join splits a hub only when both of its sides are shuffled for it.
    """
    keys, held = [*by, "dst"], materialize(edges, "logits")
    tops = materialize(held.groupBy(*keys).agg(*[F.max(c).alias(f"_m_{c}") for c in logits]), "tops")
    part = lambda c: F.exp(F.col(c) - F.col(f"_m_{c}"))
    shifted = held.join(tops, keys)
    sums = materialize(shifted.groupBy(*keys).agg(
        *[F.max(f"_m_{c}").alias(f"_m_{c}") for c in logits], *[F.sum(part(c)).alias(f"_z_{c}") for c in logits]), "sums")
    return held.join(sums, keys).select(*edges.columns, *[(part(c) / F.col(f"_z_{c}")).alias(f"alpha_{c}") for c in logits])


def attention_logits(edges: DataFrame, score_u: DataFrame, score_v: DataFrame, heads: int = 1, slope: float = 0.2,
                     by: Sequence[str] = ()) -> DataFrame:
    """(src, dst, l0..): leaky ReLU of the source score plus the destination score, per head."""
    u = score_u.select(*by, F.col("node_id").alias("src"), F.col("score").alias("_u"))
    v = score_v.select(*by, F.col("node_id").alias("dst"), F.col("score").alias("_v"))
    joined = edges.join(u, [*by, "src"]).join(v, [*by, "dst"])

    def logit(h: int) -> Column:
        x = F.col("_u")[h] + F.col("_v")[h]
        return F.when(x >= 0, x).otherwise(x * F.lit(slope)).alias(f"l{h}")

    return joined.select(*by, "src", "dst", *[logit(h) for h in range(heads)])


def aggregate_attention(edges: DataFrame, z: DataFrame, heads: int = 1, by: Sequence[str] = (), width: int | None = None,
                        into: DataFrame | None = None) -> DataFrame:
    """(node_id, neigh): attention-weighted sum of projected vectors, heads side by side.

    ``z`` is (node_id, feat, el, er): the projected vector with its source and destination
    scores per head. ``into`` (node_id, er) has the destinations when they are not in ``z``.
    """
    by = list(by)
    width = _width(z, "feat") if width is None else width
    edges = edges.select(*by, "src", "dst")
    ends = lambda df, end, *cols: df.groupBy(*by, F.col("node_id").alias(end)).agg(*[F.collect_list(c).alias(c) for c in cols])
    u, v = ends(z, "src", "el", "feat"), ends(z if into is None else into, "dst", "er")
    # The leaky ReLU grows with its argument, so the largest logit is that of the largest scores: one number per
    # destination is added up, and the edges meet the vectors once, without a written table of logits.
    most = lambda col, h: F.array_max(F.transform(col, lambda s: s[h]))
    tops = edges.join(u.select(*by, "src", *[most("el", h).alias(f"_t{h}") for h in range(heads)]), [*by, "src"])
    tops = tops.groupBy(*by, "dst").agg(*[F.max(f"_t{h}").alias(f"_t{h}") for h in range(heads)]).join(v, [*by, "dst"])
    # The largest logits and the scores travel with every edge, so they share one array.
    logits = F.concat(F.array(*[_leaky(F.col(f"_t{h}") + most("er", h)) for h in range(heads)]), F.flatten("er"))
    tops = materialize(tops.select(*by, "dst", logits.alias("_q")), "tops")
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    first = F.get("feat", F.lit(0))
    total = F.when(F.size("feat") < 2, first).otherwise(F.aggregate(F.slice("feat", F.lit(2), F.size("feat")), first, add))
    weights = F.array(*[_attention_weight(h, heads) for h in range(heads)])
    scored, each = edges.join(tops, [*by, "dst"]), F.lit(max(width, 1) / heads)
    how = neighbours.Deal()
    if into is not None and not by and width and width % heads == 0 and width + heads <= COLUMNS and neighbours.countable(edges):
        how = neighbours.deal(edges, width)
    if (how.shards or how.blocks) and how.slices == 1:
        weighed = scored.join(shuffled(u.select("src", "el")), "src").select("src", "dst", weights.alias("_w"))
        vectors = u.select(F.col("src").alias("node_id"), F.coalesce(total.cast("array<double>"), F.array_repeat(F.lit(0.0), width)).alias("feat"))
        rows = neighbours.partial_sums(weighed, vectors, width, how, heads).select("node_id", F.col("_v").alias("_f"))
    else:
        sent = scored.join(shuffled(u.select(*by, "src", "el", total.cast("array<double>").alias("_f"))), [*by, "src"])
        sent = sent.withColumn("_p", weights)
        scaled = F.transform("_f", lambda x, i: x * F.element_at("_p", F.floor(i / each).cast("int") + 1))
        scaled = F.concat(F.coalesce(scaled, F.array_repeat(F.lit(0.0), width)), "_p")
        rows = sent.select(*by, F.col("dst").alias("node_id"), scaled.alias("_f"))
    sums = _vector_sum(rows, [*by, "node_id"], "_f", width + heads)
    share = F.transform(F.slice("_out", 1, width), lambda x, i: x / F.element_at("_out", F.floor(i / each).cast("int") + F.lit(width + 1)))
    return sums.select(*by, "node_id", share.alias("neigh"))


def _leaky(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def _attention_weight(h: int, heads: int) -> Column:
    """exp(logit - largest logit) of head ``h``, added up over the scores ``el`` and those in ``_q`` when a node comes more than once.

    ``_q`` has the largest logits of all heads and behind them the scores of the destination, row by row.
    """
    weight = lambda a, b: F.exp(_leaky(a[h] + b) - F.col("_q")[h])
    many = F.sequence(F.lit(1), F.floor(F.size("_q") / F.lit(heads)).cast("int") - 1)
    pairs = F.flatten(F.transform("el", lambda a: F.transform(many, lambda i: weight(a, F.get("_q", i * heads + h)))))
    once = (F.size("el") == 1) & (F.size("_q") == 2 * heads)
    return F.when(once, weight(F.col("el")[0], F.col("_q")[heads + h])).otherwise(F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y))


# Dense layers -------------------------------------------------------------------


def dense(df: DataFrame, weights: Mapping[str, np.ndarray], bias: np.ndarray | None = None, act: str | None = None,
          out: str = "out") -> DataFrame:
    """Sum over columns of ``column @ weights[column]`` plus bias, then ``relu`` if asked.

    Weights have the fixed size of the model and ride with the task; rows go through NumPy
    in Arrow batches.
    """
    mats = {c: np.asarray(w, dtype=np.float64) for c, w in weights.items()}
    shift = None if bias is None else np.asarray(bias, dtype=np.float64)
    kept = [c for c in df.columns if c not in mats and c != out]

    def block(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            total = sum(block(batch.column(c), n) @ w for c, w in mats.items())
            if shift is not None:
                total = total + shift
            if act == "relu":
                total = np.maximum(total, 0.0)
            ends = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
            result = pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], result], [*kept, out])

    schema = df.select(*kept, F.array(F.lit(0.0)).alias(out)).schema
    return df.select(*kept, *mats).mapInArrow(run, schema)


def _heads_score(df: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """Per-head dot products of the projected vector with the two attention vectors."""
    def blocks(a: np.ndarray) -> np.ndarray:
        heads, width = a.shape
        out = np.zeros((heads * width, heads))
        for h in range(heads):
            out[h * width:(h + 1) * width, h] = a[h]
        return out

    both = dense(df.withColumn("_z", F.col("feat")), {"_z": np.hstack([blocks(left), blocks(right)])}, out="_s")
    n = left.shape[0]
    return both.select(
        *[c for c in both.columns if c != "_s"],
        F.slice("_s", 1, n).alias("el"), F.slice("_s", n + 1, n).alias("er"),
    )


def _finish(vec: Column, bias: np.ndarray | None, act: str | None) -> Column:
    if bias is not None:
        vec = F.zip_with(vec, F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x + b)
    return F.transform(vec, lambda x: F.greatest(x, F.lit(0.0))) if act == "relu" else vec


def _sage(edges: DataFrame, feat: DataFrame, nodes: DataFrame, w: Mapping[str, np.ndarray], by: list[str],
          act: str | None) -> DataFrame:
    rows, cols = np.asarray(w["neigh"]).shape
    if rows <= cols:
        agg = aggregate_mean(edges, feat, nodes, by, rows)
        return dense(agg, {"feat": w["self"], "neigh": w["neigh"]}, w.get("b"), act, "h").withColumnRenamed("h", "feat")
    # The mean is linear: project first and move the shorter vectors.
    both = dense(feat.select(*by, "node_id", "feat"), {"feat": np.hstack([w["neigh"], w["self"]])}, out="z")
    both = materialize(both, "project")
    sent = _send(edges, both.select(*by, "node_id", F.slice("z", 1, cols).alias("feat")), by)
    means = _vector_sum(sent, [*by, F.col("dst").alias("node_id")], "feat", cols, "mean")
    own = both.join(nodes.select(*by, "node_id"), [*by, "node_id"], "left_semi")
    own = own.select(*by, "node_id", F.slice("z", cols + 1, cols).alias("own")).join(means, [*by, "node_id"], "left")
    total = F.zip_with("own", F.coalesce("_out", _zeros_like("own")), lambda a, b: a + b)
    return own.select(*by, "node_id", _finish(total, w.get("b"), act).alias("feat"))


def conv(kind: str, edges: DataFrame, feat: DataFrame, nodes: DataFrame, w: Mapping[str, np.ndarray],
         by: Sequence[str] = (), act: str | None = None, last: bool = False) -> DataFrame:
    """One layer: (node_id, feat) of the destinations ``nodes``.

    ``sage``: self and neigh weights; ``gcn`` and ``sage_gcn``: W; ``gat``: W, al, ar
    (heads x width). The bias ``b`` is optional. ``gat`` joins heads side by side, or
    averages them on the last layer.
    """
    by = list(by)
    bias = w.get("b")
    if kind == "sage":
        return _sage(edges, feat, nodes, w, by, act)
    if kind in ("gcn", "sage_gcn"):
        combine = aggregate_gcn if kind == "gcn" else aggregate_sage_gcn
        rows, cols = np.asarray(w["W"]).shape
        if rows > cols:  # the sum is linear: project first and move the shorter vectors
            short = materialize(dense(feat.select(*by, "node_id", "feat"), {"feat": w["W"]}, out="z"), "project")
            agg = combine(edges, short.withColumnRenamed("z", "feat"), nodes, by, cols)
            return agg.select(*by, "node_id", _finish(F.col("neigh"), bias, act).alias("feat"))
        return dense(combine(edges, feat, nodes, by, rows), {"neigh": w["W"]}, bias, act, "feat")
    if kind != "gat":
        raise ValueError(f"unknown layer kind {kind!r}")
    heads, width = np.asarray(w["al"]).shape
    z = dense(feat.select(*by, "node_id", F.col("feat").alias("x")), {"x": w["W"]}, out="feat")
    z = materialize(_heads_score(z, np.asarray(w["al"]), np.asarray(w["ar"])), "gat")
    sums = aggregate_attention(edges, z, heads, by, heads * width)
    out = nodes.select(*by, "node_id").join(sums, [*by, "node_id"], "left")
    zeros = F.array(*[F.lit(0.0)] * (heads * width))
    out = out.select(*by, "node_id", F.coalesce("neigh", zeros).alias("x"))
    vec = F.col("x")
    if last:
        mean = lambda i: fold(lambda a, b: a + b, [F.col("x")[i + h * width] for h in range(heads)]) / F.lit(heads)
        vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), mean)
        bias = None if bias is None else np.asarray(bias).reshape(heads, width).mean(0)
    return out.select(*by, "node_id", _finish(vec, bias, act).alias("feat"))


def gnn_infer(blocks: Sequence[DataFrame], feat: DataFrame, weights: Sequence[Mapping[str, np.ndarray]], kind: str,
              seeds: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(node_id, logits, prediction) after one layer per block.

    ``blocks[i]`` holds the (src, dst) edges of layer i; pass the whole edge table several
    times for full-graph inference. A layer computes only the nodes the next one reads.
    """
    by = list(by)
    h = feat
    for i, (edges, w) in enumerate(zip(blocks, weights, strict=True)):
        last = i + 1 == len(blocks)
        if last:
            nodes = feat if seeds is None else seeds
        elif seeds is None:
            nodes = feat
        else:
            ahead = blocks[i + 1]
            nodes = ahead.select(*by, F.col("src").alias("node_id")).unionByName(
                ahead.select(*by, F.col("dst").alias("node_id"))).unionByName(seeds.select(*by, "node_id"))
        nodes = nodes.select(*by, "node_id").distinct()
        h = materialize(conv(kind, edges, h, nodes, w, by, None if last else "relu", last), "layer")
    return with_argmax(h.withColumnRenamed("feat", "logits"), "logits")


def with_argmax(df: DataFrame, col: str) -> DataFrame:
    best = F.array_position(F.col(col), F.array_max(col)) - 1
    return df.withColumn("prediction", best.cast("bigint"))


def gnn_infer_hetero(typed_edges: DataFrame, feat: DataFrame, weights: Sequence[Mapping[str, Mapping[str, np.ndarray]]],
                     kind: str, linear: tuple[np.ndarray, np.ndarray], target: str) -> DataFrame:
    """Relational layers over (ntype, node_id, feat): one convolution per edge type, mixed across
    types (mean for ``rgcn``, sum for ``rsage`` and ``rgat``), then a linear head on ``target``."""
    inner = {"rgcn": "gcn", "rsage": "sage_gcn", "rgat": "gat"}[kind]
    metric = "mean" if kind == "rgcn" else "sum"
    kinds: dict[str, list[tuple[str, str]]] = {}
    for r in typed_edges.select("etype", "src_type", "dst_type").distinct().collect():  # one row per edge type
        kinds.setdefault(r.etype, []).append((r.src_type, r.dst_type))
    h, old = feat, None
    for i, layer in enumerate(weights):
        # One edge type at a time: its tables and shuffle files are gone before the next one begins.
        parts = [save_last(lambda: _relation(inner, typed_edges.filter(F.col("etype") == t), h, sorted(kinds[t]), layer[t]), "relation")  # noqa: B023
                 for t in sorted(kinds)]
        stacked = fold(DataFrame.unionByName, [p.df for p in parts])
        mixed = _vector_sum(stacked, ["ntype", "node_id"], "feat", _out_width(inner, layer), metric).withColumnRenamed("_out", "feat")
        act = "relu" if i + 1 < len(weights) else None
        new = save(mixed.withColumn("feat", _finish(F.col("feat"), None, act)), "relational")
        for p in parts:
            p.drop()
        if old:
            old.drop()
        h, old = new.df, new
    head = dense(h.filter(F.col("ntype") == target).select("node_id", "feat"), {"feat": linear[0]}, linear[1], out="logits")
    return with_argmax(head, "logits")


def _out_width(kind: str, layer: Mapping[str, Mapping[str, np.ndarray]]) -> int:
    w = next(iter(layer.values()))
    return int(np.asarray(w["al"]).size if kind == "gat" else np.asarray(w["W"]).shape[1])


def _relation(kind: str, edges: DataFrame, h: DataFrame, kinds: Sequence[tuple[str, str]], w: Mapping[str, np.ndarray]) -> DataFrame:
    """(ntype, node_id, feat): one row per destination of one edge type, between the given types of nodes."""
    side = lambda types: fold(DataFrame.unionByName, [h.filter(F.col("ntype") == t).select("node_id", F.col("feat").alias("x")) for t in types])
    src, dst = side([s for s, _ in kinds]), side([d for _, d in kinds])
    edges = edges.select("src", "dst")
    project = lambda df: dense(df, {"x": w["W"]}, out="feat")
    width = int(np.asarray(w["W"]).shape[1])
    if kind == "gat":
        heads = np.asarray(w["al"]).shape[0]
        scored = lambda df: _heads_score(project(df), np.asarray(w["al"]), np.asarray(w["ar"]))
        z = materialize(scored(src).drop("er"), "project")
        into = materialize(scored(dst).select("node_id", "er"), "ends")  # of a destination only its score counts
        sums = aggregate_attention(edges, z, heads, (), width, into)
        zeros = F.array(*[F.lit(0.0)] * width)
        out = into.select("node_id").join(sums, "node_id", "left").withColumn("neigh", F.coalesce("neigh", zeros))
    else:
        ends = dst.filter(F.col("node_id").isNotNull())
        out = (aggregate_gcn(edges, project(src), width=width, into=ends.select("node_id")) if kind == "gcn" else
               aggregate_sage_gcn(edges, project(src), width=width, into=project(ends)))
    return out.select(F.lit(kinds[-1][1]).alias("ntype"), "node_id", _finish(F.col("neigh"), w.get("b"), None).alias("feat"))


# Propagated features and a classifier -------------------------------------------


def propagate_features(edges: DataFrame, feat: DataFrame, hops: int) -> DataFrame:
    """(node_id, feat, hop): the vectors and their repeated in-neighbour means."""
    layers = [feat.select("node_id", F.col("feat").cast("array<double>").alias("feat"), F.lit(0).cast("bigint").alias("hop"))]
    current, width = feat.select("node_id", "feat"), _width(feat, "feat")
    for hop in range(1, hops + 1):
        means = _vector_sum(_send(edges, current, []), [F.col("dst").alias("node_id")], "feat", width, "mean")
        # Of the own vectors only the length is needed.
        own = current.select("node_id", F.when(F.col("feat").isNotNull(), F.size("feat")).alias("_k"))
        mean = F.coalesce("_out", F.array_repeat(F.lit(0.0), F.col("_k")))
        current = materialize(own.join(shuffled(means), "node_id", "left").select("node_id", mean.alias("feat")), "hop")
        layers.append(current.withColumn("hop", F.lit(hop).cast("bigint")))
    return fold(DataFrame.unionByName, layers)


def train_classifier(propagated: DataFrame, labels: DataFrame, max_iter: int = 20, reg: float = 0.01):
    """Multinomial logistic regression on the vectors of all hops side by side.

    ``labels`` is (node_id, label) of the training split. Returns (model, table of (node_id,
    features)).
    """
    from pyspark.ml.classification import LogisticRegression

    table = materialize(stack_hops(propagated), "train")
    rows = table.join(labels.filter(F.col("label").isNotNull()), "node_id")
    rows = rows.select(_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial").fit(rows)
    return model, table


def stack_hops(propagated: DataFrame) -> DataFrame:
    """(node_id, features): one row per node, hops in order; the list has one entry per hop."""
    hops = F.sort_array(F.collect_list(F.struct("hop", "feat")))
    return propagated.groupBy("node_id").agg(F.flatten(F.transform(hops, lambda p: p["feat"])).alias("features"))


def predict(model, table: DataFrame) -> DataFrame:
    """(node_id, prediction): the class with the largest margin, ties to the lowest."""
    margins = dense(table, {"features": model.coefficientMatrix.toArray().T}, model.interceptVector.toArray(), out="margin")
    return with_argmax(margins, "margin").select("node_id", "prediction")


def evaluate(model, table: DataFrame, nodes: DataFrame, split: str = "test") -> DataFrame:
    """Accuracy in percent on one split."""
    truth = nodes.filter(F.col("split") == split).select("node_id", "label")
    return accuracy(predict(model, table).join(truth, "node_id"))
