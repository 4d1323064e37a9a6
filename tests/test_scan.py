import random

import numpy as np
from pyspark.sql import functions as F

from nodeloom.functions.hashing import digest, hash_long, pick_ordinals, uniform
from nodeloom.plans import scan
from nodeloom.plans.skew import spread
from nodeloom.plans.store import bucket_count, save, save_bucketed, shared_folder
from tests.conftest import rows


def test_prefix_scan_over_many_blocks(make, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 4)  # forces several super-blocks too
    rng = random.Random(1)
    ids = rng.sample(range(500), 120)
    data = [(i, rng.randrange(-5, 20)) for i in ids]
    df = make.table(data, "i bigint, v bigint")
    order = sorted(data)
    run = np.cumsum([v for _, v in order])
    assert rows(scan.prefix_scan(df, "i", "v", block=3), "i", "running") == [(i, int(r)) for (i, _), r in zip(order, run)]
    before = [(i, int(r - v)) for (i, v), r in zip(order, run)]
    assert rows(scan.prefix_scan(df, "i", "v", inclusive=False, block=3), "i", "running") == before
    assert run[-1] == df.agg(F.sum("v")).first()[0]


def test_prefix_scan_empty(make):
    assert rows(scan.prefix_scan(make.table([], "i bigint, v bigint"), "i", "v")) == []


def test_global_rank_with_equal_keys(make):
    data = [(i, (i * 7) % 3) for i in range(200)]
    df = make.table(data, "id bigint, k bigint")
    got = rows(scan.global_rank(df, [F.col("k").desc(), F.col("id")]), "id", "rank")
    want = {i: r for r, (i, _) in enumerate(sorted(data, key=lambda p: (-p[1], p[0])))}
    assert got == sorted(want.items())


def test_hash_rank_is_a_permutation_in_hash_order(make):
    df = make.nodes(range(300)).withColumn("h", digest(3, F.col("node_id")))
    got = scan.hash_rank(df, "h", "node_id", digits=2).collect()
    assert sorted(r["rank"] for r in got) == list(range(300))
    assert [r["node_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["node_id"] for r in sorted(got, key=lambda r: r["h"])]


def test_grouped_rank_cuts_a_hot_key(make):
    data = [(0, v) for v in range(0, 900, 3)] + [(k, v) for k in range(1, 5) for v in range(k)]
    df = make.table(data, "k bigint, v bigint")
    got = rows(scan.grouped_rank(df, ["k"], "v", block=16), "k", "v", "ord")
    want = []
    for key in range(5):
        want += [(key, v, i) for i, v in enumerate(sorted(v for k, v in data if k == key))]
    assert got == sorted(want)


def test_chunked_lists_bound_the_list(make):
    df = make.edges([(0, d) for d in range(25)] + [(1, 9), (1, 3)])
    got = {(r.src, r.chunk): r["items"] for r in scan.chunked_lists(df, ["src"], "dst", "dst", chunk=10).collect()}
    assert got == {(0, 0): list(range(10)), (0, 1): list(range(10, 20)), (0, 2): list(range(20, 25)), (1, 0): [3, 9]}


def test_top_k_small_and_salted(make):
    df = make.table([(i % 2, i) for i in range(5000)], "g bigint, v bigint")
    for k in (3, 1500):
        got = rows(scan.top_k_per_group(df, ["g"], [F.col("v").desc()], k), "g", "v")
        want = sorted((g, v) for g in (0, 1) for v in sorted((v for v in range(5000) if v % 2 == g), reverse=True)[:k])
        assert got == want


def test_top_k_limits_rows_before_the_exchange(make):
    df = scan.top_k_per_group(make.edges([(0, 1), (0, 2)]), ["src"], [F.col("dst")], 1)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pick_ordinals_are_distinct_and_uniform(make):
    df = make.nodes(range(4000)).select(pick_ordinals(F.lit(7).cast("bigint"), 3, 1, F.col("node_id")).alias("o"))
    picks = [tuple(r["o"]) for r in df.collect()]
    assert all(len(set(p)) == 3 and set(p) <= set(range(7)) for p in picks)
    counts = np.bincount([o for p in picks for o in p], minlength=7)
    assert abs(counts - 4000 * 3 / 7).max() < 200
    few = make.nodes([1]).select(pick_ordinals(F.lit(2).cast("bigint"), 3, 1, F.col("node_id")).alias("o")).first()["o"]
    assert few == [0, 1]


def test_uniform_is_open_and_seeded(make):
    df = make.nodes(range(500)).select(uniform(5, F.col("node_id")).alias("u"), hash_long(5, F.col("node_id")).alias("h"))
    values = [r["u"] for r in df.collect()]
    assert 0 < min(values) and max(values) < 1 and abs(np.mean(values) - 0.5) < 0.05
    assert values == [r["u"] for r in df.collect()]


def test_spread_join_equals_plain_join(make):
    edges = make.edges([(0, d) for d in range(1, 60)] + [(s, 0) for s in range(1, 60)])
    table = spread(edges, "src", key_rows=5)
    assert table.hot is not None and table.hot.count() == 1
    other = make.table([(i, i * 10) for i in range(60)], "src bigint, v bigint")
    assert rows(table.join(other), "src", "dst", "v") == rows(edges.join(other, "src"), "src", "dst", "v")
    hot = table.saved.df.filter("src = 0").select("_salt").distinct().count()
    assert hot > 1


def test_saved_tables_live_in_the_shared_folder(spark, make):
    saved = save(make.nodes(range(10)), "t")
    assert saved.rows == 10 and saved.path.startswith(shared_folder(spark))
    assert spark.conf.get("spark.checkpoint.dir") in saved.path
    saved.drop()


def test_bucket_count_stays_below_sparks_limit(spark):
    assert bucket_count(spark, 1000) == 0
    assert 0 < bucket_count(spark, 10**9) < bucket_count(spark, 10**13) < 100_000


def test_block_digits_follow_the_row_count():
    assert scan.block_digits(10) == 2
    for rows_ in (10**8, 10**11, 10**13):
        digits = scan.block_digits(rows_)
        assert rows_ / 16 ** digits <= scan.BLOCK < rows_ / 16 ** (digits - 1) or digits == 2


def test_dropped_bucketed_table_leaves_the_catalog(spark, make):
    saved = save_bucketed(make.edges([(i, i) for i in range(50)]), "gone", ["src"], 4)
    before = {t.name for t in spark.catalog.listTables()}
    saved.drop()
    assert before - {t.name for t in spark.catalog.listTables()} == {saved.table}
