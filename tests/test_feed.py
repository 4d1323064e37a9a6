"""The mini-batch feed with each sampler."""

import pytest

from nodeloom.operators import feed, sampling
from tests.conftest import hub_graph, rows


@pytest.mark.parametrize("kind", ["neighbor", "layer", "cluster", "group"])
def test_every_sampler_feeds_the_features_of_its_inputs(make, kind):
    pairs = hub_graph(60)
    edges, ids = make.edges(pairs), make.nodes(range(60))
    feats = make.table([(i, [float(i), 1.0]) for i in range(60)], "node_id bigint, feat array<float>")
    seeds = feed.batches_of(ids, 15, seed=3)
    groups = make.table([(i // 6, i, (i + k) % 60) for i in range(60) for k in range(4)], "group_id bigint, src bigint, node_id bigint")
    if kind == "cluster":
        parts = make.table([(i, i % 6) for i in range(60)], "node_id bigint, part bigint")
        seeds = sampling.cluster_batches(parts, 2, seed=1)
    sampler = {"neighbor": feed.neighbor_sampler([3, 2], 1), "layer": feed.layer_sampler([8, 8], 1), "cluster": feed.cluster_sampler(),
               "group": feed.group_sampler(groups, [3, 2], 1)}[kind]
    out = feed.minibatch_feed(edges, feats, seeds, sampler)
    assert set(rows(out.blocks, "src", "dst")) <= set(pairs)
    inputs = rows(out.inputs, "batch_id", "node_id")
    assert set(rows(seeds, "batch_id", "node_id")) <= set(inputs)
    assert {(b, s) for b, s in rows(out.blocks, "batch_id", "src")} <= set(inputs)
    assert [(b, n) for b, n, f in rows(out.features, "batch_id", "node_id", "feat") if f[0] == n] == inputs
