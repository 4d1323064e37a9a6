import heapq

import numpy as np
import pytest

from nodeloom.operators import algos
from nodeloom.plans import components, skew
from tests.conftest import hub_graph, rows


@pytest.fixture(params=[False, True], ids=["plain", "hot keys cut"])
def cut(request, monkeypatch):
    """Run with and without explicit splitting of hot keys."""
    if request.param:
        original = skew.spread
        monkeypatch.setattr(algos, "spread", lambda df, key: original(df, key, key_rows=5))
    return request.param


def test_bfs_path_star_and_unreached(make):
    path = make.edges([(i, i + 1) for i in range(4)])
    assert rows(algos.bfs(path, make.nodes([0]))) == [(0, i, i) for i in range(5)]
    assert rows(algos.bfs(path, make.nodes([0]), max_depth=2)) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert rows(algos.bfs(path, make.nodes([2, 4]))) == [(2, 2, 0), (2, 3, 1), (2, 4, 2), (4, 4, 0)]


def shortest(pairs, root):
    best, queue = {}, [(0, root)]
    out = {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
    while queue:
        d, v = heapq.heappop(queue)
        if v in best:
            continue
        best[v] = d
        for u, w in out.get(v, []):
            heapq.heappush(queue, (d + w, u))
    return best


def test_sssp_matches_dijkstra(make, cut):
    weighted = [(a, b, (a * 7 + b * 3) % 11 + 1) for a, b in hub_graph(60)]
    table = make.table(weighted, "src bigint, dst bigint, w bigint")
    want = [(1, n, d) for n, d in sorted(shortest(weighted, 1).items())]
    assert rows(algos.sssp(table, make.nodes([1]))) == want
    floats = make.table([(a, b, w / 2) for a, b, w in weighted], "src bigint, dst bigint, w double")
    assert rows(algos.sssp(floats, make.nodes([1]))) == [(r, n, d / 2) for r, n, d in want]


def test_components(make, cut):
    triangles = [(5, 6), (6, 7), (7, 5), (20, 22), (22, 21), (21, 20), (3, 3)]
    got = rows(algos.connected_components(make.edges(triangles), make.nodes([9])))
    assert got == [(3, 3), (5, 5), (6, 5), (7, 5), (9, 9), (20, 20), (21, 20), (22, 20)]


ROUND_TABLES = {"cc_step", "cc_double"}


def rounds_of(pairs, make, monkeypatch):
    """Labels and the number of pointer rounds."""
    calls = []
    original = components.save
    monkeypatch.setattr(components, "save", lambda df, name="t": calls.append(name) or original(df, name))
    got = dict(rows(algos.connected_components(make.edges(pairs))))
    return got, sum(name in ROUND_TABLES for name in calls), calls.count("cc_step")


def test_an_ordered_path_takes_as_many_rounds_as_its_length_has_bits(make, monkeypatch):
    n = 1000
    got, rounds, contractions = rounds_of([(i, i + 1) for i in range(n)], make, monkeypatch)
    assert got == dict.fromkeys(range(n + 1), 0)
    assert rounds <= 15 and contractions == 1


def test_orders_that_leave_many_local_minima(make, monkeypatch):
    """A mixed path, stars whose centre has the largest id, and a comb of them."""
    n = 200
    order = [(i * 37) % n for i in range(n)]
    path = list(zip(order, order[1:]))
    stars = [(1000 + 100 * s, 300 + 50 * s + i) for s in range(8) for i in range(20)]
    comb = [(1000 + 100 * s, 1100 + 100 * s) for s in range(7)]
    got, rounds, contractions = rounds_of(path + stars + comb, make, monkeypatch)
    assert all(got[i] == 0 for i in range(n)) and all(got[x] == 300 for pair in stars for x in pair)
    assert contractions <= 8 and rounds <= 32


def test_components_match_a_plain_search(make):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for node in sorted(near):
            stack = [node] if node not in want else []
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = node
                    stack += near[x]
        assert dict(rows(algos.connected_components(make.edges(pairs)))) == want


def test_pagerank_matches_numpy(make, cut):
    pairs = hub_graph(50)
    n = 52  # two isolated nodes
    for norm in ("in", "out"):
        a = np.zeros((n, n))
        for s, d in pairs:
            a[d, s] += 1
        deg = np.maximum(a.sum(1) if norm == "in" else a.sum(0), 1)
        v = np.full(n, 1 / n)
        for _ in range(7):
            v = 0.15 / n + 0.85 * (a @ (v / deg))
        got = rows(algos.pagerank(make.edges(pairs), make.nodes(range(n)), k=7, norm=norm, write_every=3))
        assert np.allclose([s for _, s in got], v, atol=1e-12)


def test_pagerank_simple_drops_parallel_edges(make):
    nodes = make.nodes(range(3))
    double = make.edges([(0, 1), (0, 1), (1, 2)])
    single = make.edges([(0, 1), (1, 2)])
    assert rows(algos.pagerank(double, nodes, k=3, simple=True)) == rows(algos.pagerank(single, nodes, k=3))
    assert rows(algos.pagerank(double, nodes, k=3)) != rows(algos.pagerank(single, nodes, k=3))


def test_pagerank_out_keeps_mass_without_dangling_nodes(make):
    ring = make.edges([(i, (i + 1) % 5) for i in range(5)] + [(0, 2)])
    total = sum(s for _, s in rows(algos.pagerank(ring, make.nodes(range(5)), norm="out")))
    assert total == pytest.approx(1.0)


def test_hetero_pagerank_keeps_types_apart(make):
    edges = make.table([("e", "a", 1, "b", 1), ("e", "a", 2, "b", 1), ("f", "b", 1, "a", 2)],
                       "etype string, src_type string, src bigint, dst_type string, dst bigint")
    nodes = make.table([("a", 1), ("a", 2), ("b", 1)], "ntype string, node_id bigint")
    got = {(t, i): s for t, i, s in rows(algos.pagerank_hetero(edges, nodes, k=1))}
    base = 0.15 / 3
    assert got == pytest.approx({("a", 1): base, ("a", 2): base + 0.85 / 3, ("b", 1): base + 0.85 * 2 / 3})


def test_hetero_pagerank_moves_numbers_and_keeps_every_id(make):
    for far in (-7, (1 << 63) - 1):  # the second leaves no bits for the type
        edges = make.table([("e", "a", 1, "b", far), ("f", "b", far, "c", 1)], "etype string, src_type string, src bigint, dst_type string, dst bigint")
        nodes = make.table([("a", 1), ("c", 1), ("b", far), ("b", 1)], "ntype string, node_id bigint")
        got = {(t, i): s for t, i, s in rows(algos.pagerank_hetero(edges, nodes, k=1))}
        base = 0.15 / 4
        assert got == pytest.approx({("a", 1): base, ("b", 1): base, ("b", far): base + 0.85 / 4, ("c", 1): base + 0.85 / 4})
        key, _ = algos._typed_keys(edges, nodes)
        assert nodes.select(key("ntype", "node_id").alias("k")).schema["k"].dataType.simpleString() == ("bigint" if far < 0 else "string")


def test_contraction_labels_with_the_least_node(make):
    import random

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(20, 70)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300)]
    rng.shuffle(pairs)
    got = dict(rows(algos.connected_components(make.edges(pairs), make.nodes([7]))))
    assert {got[i] for i in range(20, 71)} == {20} and {got[100 + i] for i in range(50)} == {100}
    assert got[300] == 300 and got[7] == 7 and len(got) == 51 + 50 + 2


def test_components_leave_only_their_result_in_the_folder(spark, make):
    import os

    from nodeloom.plans.store import shared_folder

    edges = make.edges([(i, i + 1) for i in range(40)]).toDF("a", "b")
    components.components(edges).drop()
    before = set(os.listdir(shared_folder(spark)))
    found = components.components(edges)
    assert set(os.listdir(shared_folder(spark))) - before == {os.path.basename(found.path)}
    found.drop()
