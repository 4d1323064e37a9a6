import random
import re

import pytest

from nodeloom.operators import layout, ordering, sets, stats
from tests.conftest import rows

GROUP = "group_id bigint, src bigint, slot bigint, node_id bigint"


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), min(rng.randrange(n), rng.randrange(n))) for _ in range(m)})


def lists(pairs):
    out = {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    for a, nbrs in out.items():  # the self loop comes last
        if a in nbrs:
            nbrs.remove(a)
            nbrs.append(a)
    return out


def walk(adj, order, k, cap, skip_used):
    """The sequential rule, written as sets and lists."""
    used, groups = set(), []
    for node in order:
        if skip_used and node in used:
            continue
        free = [x for x in adj.get(node, []) if x not in used]
        for g in range(min(cap, len(free) // k)):
            groups.append((node, free[g * k:(g + 1) * k]))
            used.update(free[g * k:(g + 1) * k])
    return groups


def as_groups(df):
    out = {}
    for g, s, slot, n in rows(df, "group_id", "src", "slot", "node_id"):
        out.setdefault((g, s), []).append(n)
    return [(s, members) for (g, s), members in sorted(out.items())]


def in_order(pairs, scores, n, descending=False):
    deg = {i: 0 for i in range(n)}
    for a, _ in pairs:
        deg[a] += 1
    return sorted(range(n), key=lambda i: ((-deg[i] if descending else deg[i]), -scores[i], i))


@pytest.mark.parametrize("seed,n,m,k", [(1, 40, 220, 4), (2, 60, 150, 2), (3, 25, 30, 4)])
def test_disjoint_groups_equal_the_walk_and_the_fill(make, seed, n, m, k):
    pairs = random_graph(n, m, seed) + [(i, i) for i in range(n)]
    pairs = sorted(set(pairs))
    scores = [(i * 13) % 7 / 7 for i in range(n)]
    nodes = make.nodes(range(n))
    adj = layout.neighbor_order(make.edges(pairs))
    table = make.table(list(enumerate(scores)), "node_id bigint, score double")
    order = ordering.processing_order(stats.degrees(make.edges(pairs), nodes, "out").join(table, "node_id"))
    got = layout.group_neighbors(adj, order, k)
    want = walk(lists(pairs), in_order(pairs, scores, n), k, 1, True)
    assert as_groups(got) == want

    for redundancy in (0.0, 0.2, 5.0):
        filled = as_groups(layout.fill_groups(adj, got, nodes, k, redundancy))
        assert filled == want + sequential_fill(lists(pairs), want, n, k, redundancy)


def sequential_fill(adj, groups, n, k, redundancy):
    used = {x for _, members in groups for x in members}
    slots, extra = len(groups) * k, []
    for node in [i for i in range(n) if i not in used]:
        if (slots + n - len(used)) / n >= 1 + redundancy:
            break
        if len(adj.get(node, [])) >= k:
            extra.append((node, adj[node][:k]))
            slots += k
            used.update(adj[node][:k])
    return extra


@pytest.mark.parametrize("seed,n,m,k,cap", [(4, 40, 260, 2, 5), (5, 50, 160, 4, 3)])
def test_multi_groups_equal_the_walk_and_the_fill(make, seed, n, m, k, cap):
    pairs = random_graph(n, m, seed)
    scores = [(i * 5) % 11 / 11 for i in range(n)]
    table = make.table(list(enumerate(scores)), "node_id bigint, score double")
    ranked = layout.rank_neighbors(make.edges(pairs), table)
    order = layout.degree_order(make.edges(pairs), make.nodes(range(n)), table, "degree_desc")
    adj = {a: sorted(nb, key=lambda x: (-scores[x], x)) for a, nb in lists(pairs).items()}
    sequence = in_order(pairs, scores, n, descending=True)
    got = layout.group_neighbors_multi(ranked, order, k, cap)
    want = walk(adj, sequence, k, cap, False)
    assert as_groups(got) == want
    for redundancy in (0.0, 0.4, 9.0):
        extra, used = [], {x for _, mm in want for x in mm}
        slots = len(want) * k
        have = {i: sum(s == i for s, _ in want) for i in range(n)}
        for node in sequence:
            if have[node] >= cap:
                continue
            nbrs = adj.get(node, [])
            for g in range(min(cap - have[node], len(nbrs) // k)):
                extra.append((node, nbrs[g * k:(g + 1) * k]))
                slots += k
                used.update(nbrs[g * k:(g + 1) * k])
            if slots + n - len(used) >= int(n * (1 + redundancy)):
                break
        assert as_groups(layout.fill_groups_multi(ranked, got, order, k, cap, redundancy)) == want + extra


@pytest.mark.parametrize("exclusive", [True, False])
def test_what_a_source_holds_for_certain_is_taken_at_once(make, monkeypatch, exclusive):
    """Every list ends with the first choice of the next source; nobody needs to wait for the one before."""
    n, k = 12, 2
    pairs = [(i, x) for i in range(n) for x in (100 + i, 200 + i, 300 + i, 101 + i)]
    adj = make.table([(i, x, p) for p, (i, x) in enumerate(pairs)], "src bigint, dst bigint, npos bigint")
    order = make.table([(i, i) for i in range(n)], "node_id bigint, rank bigint")
    rounds = []
    original = layout.save
    monkeypatch.setattr(layout, "save", lambda df, name="table": rounds.append(name) or original(df, name))
    got = layout.group_neighbors(adj, order, k) if exclusive else layout.group_neighbors_multi(adj, order, k, 1)
    assert as_groups(got) == [(i, [100 + i, 200 + i]) for i in range(n)]
    assert rounds.count("live") <= 4


def test_rounds_broadcast_no_table_with_two_keys(make, monkeypatch, capsys):
    """Such a table takes a whole memory page on the driver, however few rows it has, and the walk has many rounds."""
    n = 30
    pairs = sorted(set(random_graph(n, 160, 6) + [(i, i) for i in range(n)]))
    order = make.table([(i, i) for i in range(n)], "node_id bigint, rank bigint")
    adj = layout.neighbor_order(make.edges(pairs))
    rounds = []

    def kept(df, name="table", real=layout.save):
        rounds.extend([df] * (name == "commits"))
        if name == "commits":
            df.explain()
        return real(df, name)

    monkeypatch.setattr(layout, "save", kept)
    groups = layout.group_neighbors(adj, order, 4)
    filled = layout.fill_groups(adj, groups, make.nodes(range(n)), 4, 5.0)
    groups.explain()
    filled.explain()
    assert rounds
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*, [^\]]*\], .*", capsys.readouterr().out)


def test_no_source_can_fill_a_group(make):
    order = make.table([(0, 0), (1, 1)], "node_id bigint, rank bigint")
    adj = layout.neighbor_order(make.edges([(0, 1)]))
    assert rows(layout.group_neighbors(adj, order, 4)) == []


def test_sequence_and_reordering(make):
    groups = make.table([(0, 5, 0, 3), (0, 5, 1, 1), (1, 2, 0, 3), (1, 2, 1, 0)], GROUP)
    nodes = make.nodes(range(6))
    seq = layout.node_sequence(groups, nodes)
    assert rows(seq) == [(0, 3), (1, 1), (2, 3), (3, 0), (4, 2), (5, 4), (6, 5)]
    feats = make.table([(i, [float(i)]) for i in range(6)], "node_id bigint, feat array<float>")
    assert [f[0] for _, f in rows(layout.reorder_features(feats, seq))] == [3, 1, 3, 0, 2, 4, 5]


def test_layout_from_sets_takes_the_first_occurrence(make):
    sets_ = make.table([(0, 0, 4), (0, 1, 2), (1, 0, 2), (1, 1, 5)], "set_rank bigint, pos bigint, node_id bigint")
    assert [n for _, n in rows(layout.layout_from_sets(sets_, make.nodes(range(6))))] == [4, 2, 5, 0, 1, 3]


def overlap_table(make, overlap):
    return make.table([(i, j, n) for (i, j), n in overlap.items()], "i bigint, j bigint, n bigint")


def plain_chain(overlap, count):
    near = {}
    for (i, j), n in overlap.items():
        near.setdefault(i, []).append((-n, j))
    chain, left, low = [0], set(range(1, count)), 1
    while left:
        best = min((x for x in near.get(chain[-1], []) if x[1] in left), default=None)
        while low not in left:
            low += 1
        chain.append(best[1] if best else low)
        left.remove(chain[-1])
    return chain


def test_chain_prefers_overlap_then_the_lowest(make):
    overlap = {(0, 2): 3, (2, 0): 3, (0, 1): 1, (1, 0): 1}
    assert layout.chain_sets(overlap_table(make, overlap), 4) == [0, 2, 1, 3]
    none = overlap_table(make, overlap).limit(0)
    assert layout.chain_sets(none, 1) == [0] and layout.chain_sets(none, 3) == [0, 1, 2] and layout.chain_sets(none, 0) == []


@pytest.mark.parametrize("near", [1, 3])
def test_chain_with_short_lists_is_the_plain_chain(make, near):
    rng = random.Random(6)
    pairs = {(i, j): rng.randrange(1, 5) for i in range(25) for j in range(i) if rng.random() < 0.3}
    overlap = pairs | {(j, i): n for (i, j), n in pairs.items()}
    assert layout.chain_sets(overlap_table(make, overlap), 27, near) == plain_chain(overlap, 27)


def test_chain_of_five_thousand_sets(spark, make, monkeypatch):
    """Every set shares members with its 20 nearest in a ring of mixed order; lists are drawn a few times only."""
    count, draws = 5000, []
    place = [(i * 1237) % count for i in range(count)]
    at = {p: i for i, p in enumerate(place)}
    overlap = {(i, at[(place[i] + d) % count]): 30 - abs(d) for i in range(count) for d in range(-10, 11) if d}
    original = layout.top_k_per_group
    monkeypatch.setattr(layout, "top_k_per_group", lambda *a, **k: draws.append(1) or original(*a, **k))
    assert layout.chain_sets(overlap_table(make, overlap), count) == plain_chain(overlap, count)
    assert len(draws) <= 5


def test_reorganize_graph_matches_brute_force(make):
    pairs = random_graph(40, 110, 9)
    hops, below, k = 2, 5, 6
    indeg = {i: sum(b == i for _, b in pairs) for i in range(40)}
    seeds = sorted((i for i in range(40) if indeg[i] < below), key=lambda i: (-indeg[i], i))[:k]
    members = []
    for s in seeds:
        seen = {s}
        for _ in range(hops):
            seen |= {a for a, b in pairs if b in seen}
        members.append([s] + sorted(seen - {s}))
    chain, left = [0], set(range(1, k))
    while left:
        nxt = max(left, key=lambda j: (len(set(members[chain[-1]]) & set(members[j])), -j))
        chain.append(nxt)
        left.remove(nxt)
    want = []
    for n in [n for c in chain for n in members[c]] + list(range(40)):
        if n not in want:
            want.append(n)
    got = rows(layout.reorganize_graph(make.edges(pairs), make.nodes(range(40)), hops, below, k))
    assert [n for _, n in got] == want


def test_colocation(make):
    edges = make.edges([(2, 0), (1, 0), (0, 2)])
    feats = make.table([(i, [float(i)]) for i in range(3)], "node_id bigint, feat array<float>")
    got = rows(layout.colocate_neighbors(edges, feats))
    assert [(p, n, m) for p, n, m, _ in got] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 2, 2), (5, 2, 0)]


def test_whole_job_invariants(make):
    n = 50
    pairs = [p for p in random_graph(n, 300, 11) if p[0] != p[1]]
    nodes = make.nodes(range(n))
    feats = make.table([(i, [float(i)]) for i in range(n)], "node_id bigint, feat array<float>")
    scores = make.table([(i, float(i % 9)) for i in range(n)], "node_id bigint, score double")
    out = layout.prepare_layout(make.edges(pairs), nodes, feats, scores, make.nodes([0, 1]))
    assert out["check"].first()["invalid"] == 0
    order = [x for _, x in rows(out["sequence"])]
    assert set(order) == set(range(n)) and [f[0] for _, f in rows(out["features"])] == order
    assert out["storage"].first()["total_slots"] == len(order)
    report = sets.supernode_report(sets.add_self_loops(make.edges(pairs), nodes, "missing"), out["groups"]).first()
    assert report.expected_deleted == report.actual_deleted
