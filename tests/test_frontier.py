"""Frontier search: rows written, buckets, merging of parts."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import algos
from nodeloom.plans import frontier, skew
from nodeloom.plans.store import Parts
from tests.conftest import hub_graph, rows


@pytest.fixture
def searches(monkeypatch):
    """Every search that ran."""
    seen = []
    original = frontier.Search.run
    monkeypatch.setattr(frontier.Search, "run", lambda self: seen.append(self) or original(self))
    return seen


def shortest(pairs, root):
    best, queue, out = {}, [(0, root)], {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, w))
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for u, w in out.get(v, []):
                heapq.heappush(queue, (d + w, u))
    return best


def test_bfs_writes_every_reached_node_once(make, searches):
    n = 34
    pairs = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(0, 5), (100, 101)]
    got = rows(algos.bfs(make.edges(pairs), make.nodes([0])))
    assert [r[2] for r in got] == [i if i < 3 else min(i, abs(i - 5) + 1) for i in range(n + 1)]
    (search,) = searches
    assert search.state.written == n + 1
    # 16 parts go into one, so every row is written again once at most
    assert search.rounds > Parts.FAN and search.state.merged <= search.state.written


def test_roots_given_twice_count_once(make):
    assert rows(algos.bfs(make.edges([(1, 2)]), make.nodes([1, 1]))) == [(1, 1, 0), (1, 2, 1)]


@pytest.mark.parametrize(("width", "key_rows", "whole"), [(None, 5, 10), (1, 10**6, 10**6), (3, 10**6, 10), (1000, 5, 10**6)])
def test_sssp_for_any_bucket_width(make, monkeypatch, width, key_rows, whole):
    monkeypatch.setattr(frontier, "WHOLE_ROWS", whole)
    original = skew.spread
    monkeypatch.setattr(algos, "spread", lambda df, key: original(df, key, key_rows=key_rows))
    weighted = [(a, b, (a * 7 + b * 3) % 11 + (a != 3)) for a, b in hub_graph(25)]
    table = make.table(weighted, "src bigint, dst bigint, w bigint")
    want = sorted((r, n, d) for r in (1, 2) for n, d in shortest(weighted, r).items())
    assert rows(algos.sssp(table, make.nodes([1, 2]), width=width)) == want


def test_buckets_write_fewer_changes_when_hops_and_weights_disagree(make, searches):
    """Many short hops beat one long one: without buckets every node falls again and again."""
    n = 12
    weighted = [(a, b, 1 if b == a + 1 else 10 * (b - a)) for a in range(n) for b in range(a + 1, n)]
    table = make.table(weighted, "src bigint, dst bigint, w bigint")
    want = [(0, i, i) for i in range(n)]
    assert rows(algos.sssp(table, make.nodes([0]))) == want
    assert rows(algos.sssp(table, make.nodes([0]), width=5)) == want
    free, bucketed = searches
    assert bucketed.state.written < free.state.written


def plans_of(make, n=50):
    """Physical plans of the rounds of a search along a path."""
    search = frontier.Search(skew.spread(make.edges([(i, i + 1) for i in range(n)]), "src"),
                             make.table([(0, 0, 0)], "root bigint, node_id bigint, val bigint"), lambda: F.col("val") + 1, ["root"])
    plans, original = [], search.state.add
    search.state.add = lambda df, **m: plans.append(df._jdf.queryExecution().executedPlan().toString()) or original(df, **m)
    assert search.run().count() == n + 1
    return plans


def test_a_round_shuffles_its_messages_once(make):
    assert all(p.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in p for p in plans_of(make, 10)[1:])


def test_few_messages_never_shuffle_a_large_state(make, monkeypatch):
    monkeypatch.setattr(frontier, "WHOLE_ROWS", 4)
    assert "Exchange hashpartitioning" not in plans_of(make)[-1]


def test_parts_merge_by_levels_and_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(Parts, "FAN", 3)
    table = Parts(spark.range(0), "parts")
    for i in range(20):
        seen = table.add(spark.range(i, i + 1), top=F.max("id"))
        assert (seen["n"], seen["top"]) == (1, i) and [r[0] for r in table.newest.collect()] == [i]
        assert sorted(r[0] for r in table.df.collect()) == list(range(i + 1))
    assert all(len(level) <= 3 for level in table.levels) and table.written == 20 and table.merged <= 2 * 20
    table.add(spark.range(0))
    assert table.df.count() == 20
    table.drop()
    assert table.df.count() == 0


def test_a_search_drops_its_edge_table(spark, make, searches):
    import os

    found = algos.bfs(make.edges([(0, 1), (1, 2)]), make.nodes([0]))
    assert not os.path.exists(searches[0].edges.saved.path)
    assert found.count() == 3


def test_random_graphs_against_dijkstra(make):
    rng = random.Random(1)
    weighted = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 50) / 4) for _ in range(120)]
    table = make.table(weighted, "src bigint, dst bigint, w double")
    got = rows(algos.sssp(table, make.nodes([0]), width=4.0))
    assert got == [(0, n, d) for n, d in sorted(shortest(weighted, 0).items())]
