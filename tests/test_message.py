from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import message
from nodeloom.plans.store import materialize, shared_folder
from tests.conftest import hub_graph, rows

N, F_IN = 30, 6
PAIRS = sorted(set(hub_graph(N, 5)))
RNG = np.random.default_rng(0)
X = RNG.normal(size=(N, F_IN))
A = np.zeros((N, N))
for _s, _d in PAIRS:
    A[_d, _s] = 1


def features(make, x=X):
    return make.table([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id bigint, feat array<double>")


def matrix(df, col):
    return np.array([r[col] for r in df.orderBy("node_id").collect()])


def mean_in(x):
    return A @ x / np.maximum(A.sum(1, keepdims=True), 1)


def softmax_rows(logits):
    out = np.where(A > 0, np.exp(logits), 0)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def gat_layer(x, w, last):
    z = x @ w["W"]
    heads, width = w["al"].shape
    outs = []
    for h in range(heads):
        zh = z[:, h * width:(h + 1) * width]
        raw = (zh @ w["al"][h])[None, :] + (zh @ w["ar"][h])[:, None]
        outs.append(softmax_rows(np.where(raw >= 0, raw, 0.2 * raw)) @ zh)
    return np.mean(outs, axis=0) if last else np.hstack(outs)


def test_vector_aggregations(make):
    edges, feat = make.edges(PAIRS), features(make)
    assert np.allclose(matrix(message.aggregate_mean(edges, feat), "neigh"), mean_in(X))
    out_deg, in_deg = np.maximum(A.sum(0), 1), np.maximum(A.sum(1), 1)
    assert np.allclose(matrix(message.aggregate_gcn(edges, feat), "neigh"), (A / np.sqrt(np.outer(in_deg, out_deg))) @ X)
    assert np.allclose(matrix(message.aggregate_sage_gcn(edges, feat), "neigh"), (A @ X + X) / (A.sum(1, keepdims=True) + 1))
    some = make.nodes([0, 3])
    assert np.allclose(matrix(message.aggregate_mean(edges, feat, some), "neigh"), mean_in(X)[[0, 3]])


def test_scalar_messages(make):
    edges = make.table([(0, 2, 2.0), (1, 2, 3.0), (2, 0, 4.0)], "src bigint, dst bigint, w double")
    vals = make.table([(0, 1.0), (1, 5.0), (2, 8.0)], "node_id bigint, val double")
    assert rows(message.copy_u(edges, vals, "mean")) == [(0, 8.0), (2, 3.0)]
    assert rows(message.copy_u(edges, vals, lambda c: F.max(c * 2))) == [(0, 16.0), (2, 10.0)]
    assert rows(message.copy_e(edges, "w", "sum")) == [(0, 4.0), (2, 5.0)]
    assert rows(message.edge_op(edges, "e_div_u", vals)) == [(0, 2, 2.0), (1, 2, 0.6), (2, 0, 0.5)]
    assert rows(message.edge_op(edges, "e_mul_v", vals)) == [(0, 2, 16.0), (1, 2, 24.0), (2, 0, 4.0)]
    soft = message.edge_softmax(edges.withColumnRenamed("w", "logit")).groupBy("dst").agg(F.sum("alpha_logit").alias("s"))
    assert all(s == pytest.approx(1) for _, s in rows(soft))


@pytest.mark.parametrize("hidden", [3, 9])
def test_sage_and_gcn_layers_project_either_way(make, hidden):
    """A narrow layer projects before it aggregates, a wide one after; the values agree."""
    edges, feat = make.edges(PAIRS), features(make)
    nodes = make.nodes(range(N))
    w = {"self": RNG.normal(size=(F_IN, hidden)), "neigh": RNG.normal(size=(F_IN, hidden)), "b": RNG.normal(size=hidden)}
    got = matrix(message.conv("sage", edges, feat, nodes, w, act="relu"), "feat")
    assert np.allclose(got, np.maximum(X @ w["self"] + mean_in(X) @ w["neigh"] + w["b"], 0))
    g = {"W": w["self"], "b": w["b"]}
    out_deg, in_deg = np.maximum(A.sum(0), 1), np.maximum(A.sum(1), 1)
    got = matrix(message.conv("gcn", edges, feat, nodes, g), "feat")
    assert np.allclose(got, (A / np.sqrt(np.outer(in_deg, out_deg))) @ X @ g["W"] + g["b"])


def test_attention_network_with_two_heads(make):
    edges, feat = make.edges(PAIRS), features(make)
    w = [{"W": RNG.normal(size=(F_IN, 8)), "al": RNG.normal(size=(2, 4)), "ar": RNG.normal(size=(2, 4))},
         {"W": RNG.normal(size=(8, 6)), "al": RNG.normal(size=(2, 3)), "ar": RNG.normal(size=(2, 3))}]
    h = np.maximum(gat_layer(X, w[0], False), 0)
    h = gat_layer(h, w[1], True)
    out = message.gnn_infer([edges, edges], feat, w, "gat")
    assert np.allclose(matrix(out, "logits"), h)
    assert [p for _, p in rows(out, "node_id", "prediction")] == list(h.argmax(1))


def test_attention_writes_no_table_of_edges_and_counts_repeated_nodes(make, monkeypatch):
    written = []
    monkeypatch.setattr(message, "materialize", lambda df, name="table": written.append((name, df.count())) or df)
    z = make.table([(0, [1.0, 2.0], [0.5], [0.1]), (1, [3.0, -1.0], [-2.0], [0.3]), (2, [0.5, 0.5], [900.0], [-0.2])],
                   "node_id bigint, feat array<double>, el array<double>, er array<double>")
    edges = make.edges([(0, 1), (1, 1), (2, 1), (0, 2), (1, 2), (1, 2)])
    got = dict(rows(message.aggregate_attention(edges, z)))
    logits = np.array([0.5 - 0.2, 0.2 * (-2.0 - 0.2), 0.2 * (-2.0 - 0.2)])
    p = np.exp(logits) / np.exp(logits).sum()
    assert np.allclose(got[1], [0.5, 0.5]) and np.allclose(got[2], p @ np.array([[1.0, 2.0], [3.0, -1.0], [3.0, -1.0]]))
    assert all(n < 6 for _, n in written)
    twice = dict(rows(message.aggregate_attention(edges, z.unionByName(z))))
    assert all(np.allclose(twice[i], 2 * np.array(got[i])) for i in (1, 2))


def test_propagation_moves_only_the_length_of_own_vectors(make):
    feat = features(make).withColumn("feat", F.col("feat").cast("array<float>"))
    plans = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(message, "materialize", lambda df, name="table": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
        message.propagate_features(make.edges(PAIRS), feat, 1)
    assert "size(" in plans[0] and "lambdafunction(0.0" not in plans[0]  # zeros made from the own vector


@pytest.mark.parametrize("kind", ["rsage", "rgat", "rgcn"])
def test_relational_network(make, kind):
    """Two node types, one edge type each way; ids overlap between the types."""
    ab = [(s, d) for s, d in PAIRS if s < 15 and d < 15]
    ba = [(d, s) for s, d in PAIRS if s < 15 and d < 15 and (s + d) % 2]
    typed = [("ab", "a", s, "b", d) for s, d in ab] + [("ba", "b", s, "a", d) for s, d in ba]
    edges = make.table(typed, "etype string, src_type string, src bigint, dst_type string, dst bigint")
    xa, xb = X[:15], X[15:]
    feat = make.table([("a", i, list(map(float, r))) for i, r in enumerate(xa)] + [("b", i, list(map(float, r))) for i, r in enumerate(xb)],
                      "ntype string, node_id bigint, feat array<double>")

    def weights(rows_in):
        if kind == "rgat":
            return {"W": RNG.normal(size=(rows_in, 4)), "al": RNG.normal(size=(2, 2)), "ar": RNG.normal(size=(2, 2))}
        return {"W": RNG.normal(size=(rows_in, 4)), "b": RNG.normal(size=4)}

    layers = [{"ab": weights(F_IN), "ba": weights(F_IN)}, {"ab": weights(4), "ba": weights(4)}]
    linear = (RNG.normal(size=(4, 3)), RNG.normal(size=3))

    def one(pairs, xs, xd, w):
        m = np.zeros((15, 15))
        for s, d in pairs:
            m[d, s] = 1
        if kind == "rgcn":
            return (m / np.sqrt(np.outer(np.maximum(m.sum(1), 1), np.maximum(m.sum(0), 1)))) @ xs @ w["W"] + w["b"]
        if kind == "rsage":
            return (m @ xs + xd) / (m.sum(1, keepdims=True) + 1) @ w["W"] + w["b"]
        outs = []
        for h in range(2):
            zs, zd = (xs @ w["W"])[:, h * 2:h * 2 + 2], (xd @ w["W"])[:, h * 2:h * 2 + 2]
            raw = (zs @ w["al"][h])[None, :] + (zd @ w["ar"][h])[:, None]
            e = np.where(m > 0, np.exp(np.where(raw >= 0, raw, 0.2 * raw)), 0)
            outs.append(e / np.maximum(e.sum(1, keepdims=True), 1e-300) @ zs)
        return np.hstack(outs)

    ha, hb = xa, xb
    for i, layer in enumerate(layers):
        hb, ha = one(ab, ha, hb, layer["ab"]), one(ba, hb, ha, layer["ba"])
        if i == 0:
            ha, hb = np.maximum(ha, 0), np.maximum(hb, 0)
    got = message.gnn_infer_hetero(edges, feat, layers, kind, linear, "a")
    assert np.allclose(matrix(got, "logits"), ha @ linear[0] + linear[1])


def test_propagation_and_classifier(make):
    edges, feat = make.edges(PAIRS), features(make)
    hops = message.propagate_features(edges, feat, 2)
    assert np.allclose(matrix(hops.filter("hop = 2"), "feat"), mean_in(mean_in(X)))
    nodes = make.table([(i, int(X[i, 0] > 0), "train" if i % 2 else "test") for i in range(N)], "node_id bigint, label int, split string")
    model, table = message.train_classifier(hops, nodes.filter("split = 'train'").select("node_id", "label"), 50, 0.001)
    assert message.evaluate(model, table, nodes, "train").first()["accuracy"] > 90
    assert message.evaluate(model, table, nodes, "test").first()["n"] == N // 2


@pytest.mark.parametrize("metric", ["sum", "mean"])
@pytest.mark.parametrize("width", [1, 6, 64, 96, 97, 1024])
def test_vector_sums_take_one_exchange_at_any_width(spark, make, width, metric):
    x = RNG.normal(size=(40, width))
    table = make.table([(i % 7, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, None)], "k bigint, v array<double>").repartition(4)
    out = message._vector_sum(table, ["k"], "v", message._width(table, "v"), metric)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
    got = {r["k"]: r["_out"] for r in out.collect()}
    for k in range(7):
        assert np.allclose(got[k], getattr(x[k::7], metric)(axis=0))
    with pytest.raises(Exception, match="entries"):
        message._vector_sum(table, ["k"], "v", width + 1, metric).collect()


def test_mean_aggregation_of_wide_vectors(make):
    wide = RNG.normal(size=(N, 300))
    edges, feat = make.edges(PAIRS), features(make, wide)
    assert np.allclose(matrix(message.aggregate_mean(edges, feat), "neigh"), mean_in(wide))
    assert message.aggregate_mean(edges, feat.limit(0)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_never_broadcast(make):
    """Their bytes on disk say nothing about their size in memory."""
    edges = materialize(make.edges(PAIRS))
    wide = materialize(features(make).select("node_id", F.flatten(F.array(*[F.col("feat")] * 20)).alias("feat")))
    got = message.aggregate_mean(edges, wide)
    assert "Broadcast" not in plan(got)
    want = np.tile(A @ X / np.maximum(A.sum(1, keepdims=True), 1), 20)
    found = {r["node_id"]: r["neigh"] for r in got.collect()}
    assert np.allclose([found[i] for i in range(N)], want)


@pytest.mark.parametrize("kind", ["rsage", "rgat", "rgcn"])
def test_relational_layers_leave_one_table(make, spark, kind):
    """Tables and shuffles of a layer are deleted once its result is written."""
    edges = materialize(make.table([("to", "a", s, "a", d) for s, d in PAIRS], "etype string, src_type string, src bigint, dst_type string, dst bigint"))
    feat = materialize(features(make).select(F.lit("a").alias("ntype"), "node_id", "feat"))
    w = lambda n: {"to": {"W": np.ones((n, 4)), "al": np.ones((2, 2)), "ar": np.ones((2, 2))}}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    out = message.gnn_infer_hetero(edges, feat, [w(F_IN), w(4)], kind, (np.ones((4, 2)), np.zeros(2)), "a")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {"relational"} and len(set(folder.iterdir()) - before) == 1
    assert out.count() == N


def test_multi_update_shuffles_no_names_of_types(make):
    edges = [("a", "x", 1, "y", 7), ("a", "z", 1, "y", 7), ("b", "x", 2, "y", 7), ("b", "x", 1, None, 7), (None, "x", 2, "y", 7), ("c", None, 1, "y", 7), ("b", "x", 9, "y", 7)]
    vals = [("x", 1, 1.0), ("x", 2, 10.0), ("z", 1, 3.0), ("w", 1, 50.0), (None, 1, 70.0)]
    e = make.table(edges, "etype string, src_type string, src bigint, dst_type string, dst bigint")
    v = make.table(vals, "ntype string, node_id bigint, val double")
    out = message.multi_update(e, v, "mean", "sum")
    assert {tuple(r) for r in out.select("ntype", "node_id", "val").collect()} == {("y", 7, 2.0 + 10.0 + 10.0), (None, 7, 1.0)}
    known = message.multi_update(e, v, "mean", "max", message.edge_kinds(e).collect())
    assert {tuple(r) for r in known.select("ntype", "node_id", "val").collect()} == {("y", 7, 10.0), (None, 7, 1.0)}
    exchanges = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line]
    assert exchanges and not any("_type" in line or "etype" in line for line in exchanges)
