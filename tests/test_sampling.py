from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeloom.operators import sampling
from tests.conftest import hub_graph, rows

BATCHED = "batch_id bigint, node_id bigint"


def test_neighbor_blocks_are_bounded_subsets(make):
    pairs = hub_graph()
    seeds = make.table([(0, 0), (0, 5), (1, 0), (1, 7)], BATCHED)
    blocks, inputs = sampling.sample_neighbors(make.edges(pairs), seeds, [3, 2], seed=1)
    got = rows(blocks, "batch_id", "layer", "src", "dst")
    assert len(set(got)) == len(got) and all((s, d) in set(pairs) for _, _, s, d in got)
    indeg = Counter(d for _, d in pairs)
    for (b, layer, d), c in Counter((b, layer, d) for b, layer, _, d in got).items():
        assert c == min((3, 2)[layer], indeg[d])
    frontier = {(0, 0), (0, 5), (1, 0), (1, 7)}
    for layer in (1, 0):
        block = [(b, s, d) for b, x, s, d in got if x == layer]
        assert {(b, d) for b, _, d in block} == {(b, d) for b, d in frontier if indeg[d]}
        frontier |= {(b, s) for b, s, _ in block}
    assert set(rows(inputs, "batch_id", "node_id")) == frontier
    again, _ = sampling.sample_neighbors(make.edges(pairs), seeds, [3, 2], seed=1)
    other, _ = sampling.sample_neighbors(make.edges(pairs), seeds, [3, 2], seed=2)
    assert rows(again, "batch_id", "layer", "src", "dst") == got != rows(other, "batch_id", "layer", "src", "dst")


def test_neighbor_draws_are_uniform(make):
    edges = make.edges([(s, 0) for s in range(1, 9)])
    seeds = make.table([(b, 0) for b in range(2000)], BATCHED)
    blocks, _ = sampling.sample_neighbors(edges, seeds, [2])
    counts = Counter(s for _, s in rows(blocks, "batch_id", "src"))
    assert sum(counts.values()) == 4000 and max(abs(c - 500) for c in counts.values()) < 100


def test_khop(make):
    edges = make.edges([(1, 0), (2, 1), (3, 2), (0, 3), (9, 9)])
    seeds = make.table([(0, 0), (1, 9), (2, 5)], "set_id bigint, node_id bigint")
    assert rows(sampling.khop_full(edges, seeds, 2)) == [(0, 0), (0, 1), (0, 2), (1, 9), (2, 5)]
    assert rows(sampling.khop_full(edges, seeds, 0)) == [(0, 0), (1, 9), (2, 5)]


def test_hetero_sampling_stays_inside_types(make):
    typed = [("buys", "u", s, "i", d) for s in range(6) for d in range(4)] + [("likes", "i", s, "u", d) for s in range(4) for d in range(6) if s != d]
    edges = make.table(typed, "etype string, src_type string, src bigint, dst_type string, dst bigint")
    seeds = make.table([(0, "i", 1), (0, "i", 2)], "batch_id bigint, ntype string, node_id bigint")
    blocks, inputs = sampling.sample_neighbors_hetero(edges, seeds, [2, 3], seed=4)
    got = rows(blocks, "layer", "etype", "src_type", "src", "dst_type", "dst")
    assert all(tuple(r[1:]) in set(typed) for r in got)
    assert Counter((r[0], r[1], r[5]) for r in got if r[0] == 1) == {(1, "buys", 1): 3, (1, "buys", 2): 3}
    assert {t for _, t, _ in rows(inputs)} == {"u", "i"}


def test_group_sampling_prefers_own_groups_and_fills_up(make):
    pairs = [(s, 0) for s in range(1, 12)]
    groups = make.table([(0, 3), (0, 7), (0, 99), (5, 1)], "src bigint, node_id bigint")
    seeds = make.table([(b, 0) for b in range(300)], BATCHED)
    blocks, _ = sampling.sample_group_neighbors(make.edges(pairs), groups, seeds, [4])
    per = {}
    for b, s in rows(blocks, "batch_id", "src"):
        per.setdefault(b, set()).add(s)
    assert all(len(p) == 4 and {3, 7} <= p for p in per.values())
    rest = Counter(s for p in per.values() for s in p - {3, 7})
    assert set(rest) == set(range(1, 12)) - {3, 7} and max(abs(c - 600 / 9) for c in rest.values()) < 35


def test_layer_selection_law(make):
    """Two draws without replacement: the sequential law, estimated over many batches."""
    p = {1: 0.6, 2: 0.3, 3: 0.1}
    prob = make.table([(b, n, q) for b in range(4000) for n, q in p.items()], "batch_id bigint, node_id bigint, prob double")
    counts = Counter(n for _, n in rows(sampling.select_layer_nodes(prob, 2, seed=1), "batch_id", "node_id"))
    want = {n: p[n] + sum(p[m] * p[n] / (1 - p[m]) for m in p if m != n) for n in p}
    assert all(abs(counts[n] / 4000 - want[n]) < 0.03 for n in p)
    drawn = rows(sampling.select_layer_nodes(prob.filter("batch_id = 0"), 3000, seed=2, replace=True), "node_id")
    assert len(drawn) == 3000 and all(abs(c / 3000 - p[n]) < 0.04 for (n,), c in Counter(drawn).items())
    assert len(rows(sampling.select_layer_nodes(prob.filter("batch_id = 0"), 10))) == 3


def test_layer_block_weights_sum_to_degree(make):
    edges = sampling.edge_weights_by_dst(make.edges(hub_graph()))
    seeds = make.table([(0, n) for n in (0, 3, 5, 9)], BATCHED)
    blocks, inputs = sampling.sample_layerwise(edges, seeds, [20, 10], seed=3)
    for (layer, dst), in set((tuple(r),) for r in rows(blocks, "layer", "dst")):
        w = [r.w for r in blocks.filter((F.col("layer") == layer) & (F.col("dst") == dst)).collect()]
        assert sum(w) == pytest.approx(len(w))
        break
    sums = blocks.groupBy("layer", "dst").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.s == pytest.approx(r.n) for r in sums)
    assert {0, 3, 5, 9} <= {n for _, n in rows(inputs)}


def test_partitions_are_balanced_and_batches_disjoint(make):
    cliques = [(a, b) for base in (0, 10, 20, 30) for a in range(base, base + 10) for b in range(base, base + 10) if a != b]
    edges, nodes = make.edges(cliques + [(9, 10), (19, 20), (29, 30)]), make.nodes(range(40))
    parts = sampling.assign_partitions(edges, nodes, 4, rounds=4)
    assert sorted(Counter(p for _, p in rows(parts)).values()) == [10, 10, 10, 10]
    cut = sampling.edge_cut(edges, parts).first()
    assert cut.cut == 3 and cut.edges == len(cliques) + 3
    batches = rows(sampling.cluster_batches(parts, 2, seed=1))
    assert sorted(n for _, n in batches) == list(range(40)) and Counter(b for b, _ in batches) == {0: 20, 1: 20}
    member = {n: b for b, n in batches}
    sub = rows(sampling.induced_subgraph(edges, make.table(batches, BATCHED)))
    assert sub == sorted((member[a], a, b) for a, b in cliques + [(9, 10), (19, 20), (29, 30)] if member[a] == member[b])


def test_zipf_pattern_is_skewed_and_in_range(make):
    slots = make.nodes(range(5000)).withColumnRenamed("node_id", "slot")
    pos = np.array([p for _, p in rows(sampling.access_pattern(slots, 800, "zipf", seed=2, rows_per_page=8))])
    assert len(pos) == 5000 and pos.min() == 0 and pos.max() < 800 and (pos % 8 == 0).all()
    weights = np.arange(1, 101) ** -1.8
    assert abs((pos == 0).mean() - weights[0] / weights.sum()) < 0.03
    arr = make.table([(i, i * i) for i in range(800)], "i bigint, v bigint")
    total = sampling.gather_sum(sampling.access_pattern(slots, 800, "zipf", seed=2, rows_per_page=8), arr).first()
    assert (total.reads, total.total) == (5000, int((pos.astype(object) ** 2).sum()))


def test_large_index_is_bucketed_and_never_shuffled(spark, make, monkeypatch):
    from nodeloom.plans import store

    pairs = hub_graph()
    seeds = make.table([(0, 0), (1, 5)], BATCHED)
    plain, _ = sampling.sample_neighbors(make.edges(pairs), seeds, [3], seed=1)
    monkeypatch.setattr(store, "ROWS_PER_BUCKET", 40)
    index = sampling.edge_index(make.edges(pairs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layer = sampling.sample_layer(index, seeds, 3, 1, 0, 0)
        plan = layer._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("nodeloom_edge_index") - 400:]
        assert "Bucketed: true" in side and "Exchange" not in side
        assert rows(layer, "batch_id", "src", "dst") == rows(plain, "batch_id", "src", "dst")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_zipf_over_many_blocks_equals_the_inverse_cdf(spark, make):
    from nodeloom.functions.hashing import uniform

    slots = make.nodes(range(2000)).withColumnRenamed("node_id", "slot")
    got = dict(rows(sampling._zipf(slots, 500, 3, 1.2, 1, block=16), "slot", "pos"))
    cdf = np.cumsum(np.arange(1, 501) ** -1.2)
    u = dict(rows(slots.select("slot", uniform(3, F.col("slot")).alias("u"))))
    assert got == {s: int(np.searchsorted(cdf / cdf[-1], x, side="right")) for s, x in u.items()}


def test_large_typed_index_is_bucketed_by_type_and_place(spark, make, monkeypatch):
    """Draws are the same from a bucketed index, which no layer shuffles."""
    from nodeloom.plans import store

    typed = make.table([(e, "a", a, "b" if e == "e" else "a", b) for e in ("e", "f") for a, b in hub_graph(30)],
                       "etype string, src_type string, src bigint, dst_type string, dst bigint")
    seeds = make.table([(0, t, n) for t in ("a", "b") for n in (0, 3, 5)], "batch_id bigint, ntype string, node_id bigint")
    plain, _ = sampling.sample_neighbors_hetero(typed, seeds, [3, 2], seed=5)
    want = rows(plain)
    assert {r[2] for r in want} == {"e", "f"}
    monkeypatch.setattr(store, "ROWS_PER_BUCKET", 10)
    indexes = []
    original = sampling._typed_index
    monkeypatch.setattr(sampling, "_typed_index", lambda df: indexes.append(original(df)) or indexes[-1])
    cut, _ = sampling.sample_neighbors_hetero(typed, seeds, [3, 2], seed=5)
    assert rows(cut) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        draws = make.table([(0, 0, 0)], "kind int, dst bigint, ord bigint")
        plan = draws.join(indexes[0].rows, ["kind", "dst", "ord"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
