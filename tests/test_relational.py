import math
from collections import Counter

import pytest

from nodeloom.operators import access, gather, ordering, sets, stats
from nodeloom.sources import tables
from nodeloom.plans.store import materialize
from tests.conftest import hub_graph, rows


def feats(make, n):
    return make.table([(i, [float(i), float(-i)]) for i in range(n)], "node_id bigint, feat array<float>")


def test_degrees_with_isolated_and_parallel(make):
    edges = make.edges([(0, 1), (0, 1), (2, 2)])
    nodes = make.nodes(range(4))
    assert rows(stats.degrees(edges, nodes, "in")) == [(0, 0), (1, 2), (2, 1), (3, 0)]
    assert rows(stats.degrees(edges, nodes, "out")) == [(0, 2), (1, 0), (2, 1), (3, 0)]


def test_empty_edges(make):
    edges = make.edges([])
    assert stats.graph_stats(edges).first()["total_edges"] is None
    assert rows(stats.degree_histogram(edges)) == [(0, 0)]
    assert rows(stats.degrees(edges, make.nodes([5]))) == [(5, 0)]


def test_graph_stats_and_histogram(make):
    edges = make.edges([(0, i) for i in range(1, 7)] + [(1, 0), (2, 0)])
    got = stats.graph_stats(edges).first()
    assert (got.total_edges, got.unique_sources, got.max_out_degree, got.median_out_degree) == (8, 3, 6, 1.0)
    assert got.avg_out_degree == pytest.approx(8 / 3)
    assert rows(stats.degree_histogram(edges)) == [(0, 0), (1, 2), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1)]


def test_gather_keeps_order_and_duplicates_and_fails_on_missing(make):
    index = make.table([(0, 0, 3), (0, 1, 1), (0, 2, 3)], "batch_id bigint, pos bigint, node_id bigint")
    got = rows(gather.gather_features(index, feats(make, 4)), "pos", "node_id", "feat")
    assert [(p, n, f[0]) for p, n, f in got] == [(0, 3, 3.0), (1, 1, 1.0), (2, 3, 3.0)]
    missing = make.table([(0, 0, 99)], "batch_id bigint, pos bigint, node_id bigint")
    with pytest.raises(Exception, match="no feature row for 99"):
        gather.gather_features(missing, feats(make, 4)).collect()


def test_tiered_equals_plain_gather_under_skew(make):
    nodes = [0 if i % 3 == 0 else i % 40 for i in range(600)]
    index = make.table([(i // 50, i % 50, n) for i, n in enumerate(nodes)], "batch_id bigint, pos bigint, node_id bigint")
    f = feats(make, 40)
    pinned = f.filter("node_id < 8")
    plain = rows(gather.gather_features(index, f), "batch_id", "pos", "node_id", "feat")
    tiered = gather.gather_tiered(index, f, pinned)
    assert rows(tiered, "batch_id", "pos", "node_id", "feat") == plain
    assert {r["node_id"] < 8 for r in tiered.filter("tier = 'pinned'").collect()} == {True}
    assert rows(gather.gather_batches(index, f), "batch_id", "pos", "node_id", "feat") == plain
    total = gather.tier_stats(gather.tag_tier(index, pinned)).filter("batch_id IS NULL").first()
    assert total.accesses == 600 and total.pinned == sum(n < 8 for n in nodes) and total.pinned + total.storage == 600


def test_type_offsets_round_trip_and_unknown_type(make):
    nodes = make.table([("a", 0), ("a", 4), ("b", 2)], "ntype string, node_id bigint")
    offsets = tables.type_offsets(nodes, ["a", "b"])
    assert rows(offsets) == [("a", 0, 5), ("b", 5, 3)]
    encoded = gather.encode_type_offset(nodes, offsets)
    assert rows(encoded, "row_id") == [(0,), (4,), (7,)]
    assert rows(gather.decode_type_offset(encoded.select("row_id"), offsets), "ntype", "node_id") == rows(nodes)
    with pytest.raises(Exception, match="unknown node type c"):
        gather.encode_type_offset(make.table([("c", 1)], "ntype string, node_id bigint"), offsets).collect()


def test_read_trace_does_not_broadcast_the_places(make):
    """A few lengths stand for as many rows as there are ids."""
    ids = materialize(make.table([(i, i % 7) for i in range(1000)], "ord bigint, node_id bigint"))
    lengths = materialize(make.table([(0, 400), (1, 600)], "batch_id bigint, size bigint"))
    got = tables.read_trace(ids, lengths)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [ord" in plan and "BroadcastHashJoin [ord" not in plan
    assert got.count() == 1000 and got.filter("node_id = (pos + 400 * batch_id) % 7").count() == 1000


def test_read_trace_with_empty_batches_and_long_ones(make):
    sizes = [3, 0, 9000, 1]
    ids = make.table([(i, i * 3) for i in range(sum(sizes))], "ord bigint, node_id bigint")
    lengths = make.table(list(enumerate(sizes)), "batch_id bigint, size bigint")
    got = rows(tables.read_trace(ids, lengths))
    want, at = [], 0
    for b, size in enumerate(sizes):
        want += [(b, p, (at + p) * 3) for p in range(size)]
        at += size
    assert got == want


@pytest.mark.parametrize("block", [4, 4096])
def test_lookahead_and_gap(make, block):
    visits = sorted({(b, n) for b in range(60) for n in (0, b % 7, (b * b) % 11)})
    trace = make.table([(b, i, n) for i, (b, n) in enumerate(visits)] + [(0, 99, 0)], "batch_id bigint, pos bigint, node_id bigint")
    present = set(visits)
    want = [(b, n, sum((b + d, n) in present for d in range(1, 4))) for b, n in visits]
    assert rows(access.lookahead_reuse(trace, 3, block)) == want
    gaps = []
    for b, n in visits:
        before = [x for x, m in visits if m == n and x < b]
        gaps.append((b, n, b - max(before) if before else None))
    assert {tuple(r) for r in access.reuse_gap(trace, block).collect()} == set(gaps)
    assert rows(access.prefetch_intersection(trace, 3)) == [(b, n) for b, n, r in want if r]


def test_pairwise_overlap_with_a_node_in_every_set(make):
    sets_ = {s: {0} | {(s * k) % 17 for k in range(1, 6)} for s in range(12)}
    df = make.table([(s, n) for s, m in sets_.items() for n in m], "set_id bigint, node_id bigint")
    want = sorted((i, j, len(sets_[i] & sets_[j])) for i in sets_ for j in sets_ if i != j)
    for tile in (3, 1024):
        assert rows(sets.pairwise_overlap(df, tile)) == want


def test_self_loops(make):
    edges = make.edges([(0, 0), (0, 1)])
    nodes = make.nodes([0, 1])
    assert rows(sets.add_self_loops(edges, nodes)) == [(0, 0), (0, 0), (0, 1), (1, 1)]
    assert rows(sets.add_self_loops(edges, nodes, "missing")) == [(0, 0), (0, 1), (1, 1)]


def test_groups_checks_and_compression(make):
    edges = make.edges([(0, 1), (0, 2), (1, 2), (2, 0)])
    groups = make.table([(0, 0, 0, 1), (0, 0, 1, 2), (1, 1, 0, 1), (1, 1, 1, 2), (2, 2, 0, 1), (2, 2, 1, 2)],
                        "group_id bigint, src bigint, slot bigint, node_id bigint")
    assert tuple(sets.validate_groups(groups, edges).first()) == (3, 2, 1)
    assert rows(sets.compress_with_supernodes(edges, groups, 100)) == [(0, 100), (1, 101), (2, 0), (2, 102)]
    report = sets.supernode_report(edges, groups).first()
    assert (report.expected_deleted, report.actual_deleted, report.added) == (6, 3, 3)
    storage = stats.storage_report(groups, make.nodes(range(4))).first()
    assert (storage.group_slots, storage.uncovered, storage.total_slots, storage.inflation) == (6, 2, 8, 2.0)


def test_top_nodes_small_and_large_paths_agree(make, monkeypatch):
    scores = make.table([(i, float((i * 31) % 13)) for i in range(200)], "node_id bigint, score double")
    small = rows(ordering.top_nodes(scores, k=25))
    monkeypatch.setattr(ordering, "SMALL_TOP", 5)
    assert rows(ordering.top_nodes(scores, k=25)) == small
    assert len(rows(ordering.top_nodes(scores, share=0.333))) == 66


def test_batches_cover_each_node_once(make):
    nodes = make.nodes(range(103))
    got = rows(ordering.make_batches(nodes, 10, seed=4))
    assert sorted(n for _, _, n in got) == list(range(103)) and Counter(b for b, _, _ in got)[10] == 3
    assert [n for _, _, n in got] != list(range(103))
    assert rows(ordering.make_batches(nodes, 10, seed=4)) == got
    assert rows(ordering.make_batches(nodes, 10, seed=4, epoch=1)) != got
    dropped = rows(ordering.make_batches(nodes, 10, seed=4, drop_last=True))
    assert dropped == [r for r in got if r[0] < 10]


def test_synthetic_labels_exact_share(make):
    labels = rows(stats.synthesize_labels(make.nodes(range(200)), 0.1, 5, 3).filter("label IS NOT NULL"))
    assert len(labels) == 20 and all(0 <= x < 5 for _, x in labels)


def test_label_profile_counts_nan_and_null(make):
    nodes = make.table([(0, 1.0), (1, math.nan), (2, None), (3, 4.0)], "node_id bigint, label double")
    got = stats.label_profile(nodes).first()
    assert (got.total, got.n_missing, got.missing_share, list(got.sample)) == (4, 2, 0.5, [1.0, 4.0])


def test_adjacency_of_a_hub(make):
    pairs = hub_graph()
    got = {}
    for r in stats.build_adjacency(make.edges(pairs), chunk=8).orderBy("src", "chunk").collect():
        got.setdefault(r.src, []).extend(r.neighbors)
        assert r.n <= 8
    want = {}
    for a, b in pairs:
        want.setdefault(a, []).append(b)
    assert got == want


def test_split_edges(make):
    edges, hot = make.edges([(0, 1), (0, 2), (1, 2)]), make.nodes([2])
    inside, outside = sets.split_edges_by_nodes(edges, hot)
    assert rows(inside) == [(0, 2), (1, 2)] and rows(outside) == [(0, 1)]
    assert rows(sets.split_degrees(edges, make.nodes(range(3)), hot)) == [(0, 1, 1), (1, 1, 0), (2, 0, 0)]


def test_diff_and_vector_add(make):
    a = make.table([(0, 1), (1, 2), (2, None)], "i bigint, v bigint")
    b = make.table([(0, 1), (1, 3), (3, 9)], "i bigint, v bigint")
    assert {tuple(r) for r in sets.diff_tables(a, b, "i", "v").collect()} == {(1, 2, 3), (3, None, 9)}
    assert rows(stats.vector_add(a.filter("v is not null"), b)) == [(0, 2), (1, 5)]


def test_pages_neighbor_equals_the_ordered_scan(make):
    import random

    from nodeloom.operators import layout

    rng = random.Random(7)
    pairs = hub_graph(40, 3)
    nodes = make.nodes(range(40))
    slots = layout.colocated_slots(make.edges(pairs), nodes)
    place = {r.pos: (r.member, r.node_id, r.slot) for r in slots.collect()}
    accesses = [(b, p, rng.choice([0, rng.randrange(40)])) for b in range(12) for p in range(60)]
    trace = make.table(accesses, "batch_id bigint, pos bigint, node_id bigint")
    own = {node: pos for pos, (_, node, slot) in place.items() if slot == 0}
    want = []
    for b in range(12):
        seen = set()
        for _, p, n in [a for a in accesses if a[0] == b]:
            if n in seen:
                continue
            page = own[n] // 4
            seen |= {place[q][0] for q in range(page * 4, page * 4 + 4) if q in place}
            want.append((b, page, p))
    assert rows(access.pages_neighbor(trace, slots, 4)) == sorted(want)


def test_volume(make):
    trace = make.table([(0, 0, 1), (0, 1, 2), (0, 2, 9)], "batch_id bigint, pos bigint, node_id bigint")
    got = access.dataset_volume(trace, access.pages_raw(trace, 4), 100, 400).first()
    assert (got.rows_requested, got.pages_moved, got.bytes_moved) == (3, 2, 800)
    assert got.amplification == pytest.approx(800 / 300)


def test_missing_rows_fail_whatever_is_read(make):
    index = make.table([(0, 0, 1), (0, 1, 99)], "batch_id bigint, pos bigint, node_id bigint")
    f = feats(make, 4)
    for gathered in (gather.gather_features(index, f), gather.gather_batches(index, f), gather.gather_tiered(index, f, f.filter("node_id < 2"))):
        with pytest.raises(Exception, match="no feature row for 99"):
            gathered.count()
    with pytest.raises(Exception, match="no feature row for 99"):
        gather.tier_stats(gather.gather_tiered(index, f, f.filter("node_id < 2"))).collect()
    layout = make.table([(1, 0)], "node_id bigint, pos bigint")
    with pytest.raises(Exception, match="no layout slot for 99"):
        gather.remap_ids(index, layout).count()
