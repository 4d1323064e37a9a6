import numpy as np
import pytest

from nodeloom.sources import arrays, tables, writers
from tests.conftest import hub_graph, rows


@pytest.mark.parametrize("shape", ["two_rows", "two_columns", "four_columns"])
@pytest.mark.parametrize("dtype", ["<i4", "<i8", "<u4"])
def test_npy_edges_in_both_orientations(spark, tmp_path, shape, dtype):
    pairs = np.array(hub_graph(40), dtype=dtype)
    data = {"two_rows": pairs.T, "two_columns": pairs, "four_columns": np.hstack([pairs, pairs + 1])}[shape]
    np.save(tmp_path / "e.npy", np.ascontiguousarray(data))
    df = arrays.read_npy_edges(spark, str(tmp_path / "e.npy"), rows_per_task=17)
    assert df.rdd.getNumPartitions() == -(-len(pairs) // 17)
    assert rows(df) == sorted((int(a), int(b)) for a, b in pairs)


def test_npy_features_keep_the_row_id(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 7)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    got = arrays.read_npy(spark, str(tmp_path / "x.npy"), rows_per_task=8).orderBy("row").collect()
    assert [r.row for r in got] == list(range(50)) and np.allclose([r.vals for r in got], x)
    one = tables.read_features(spark, str(tmp_path / "x.npy"), "npy")
    assert one.schema["feat"].dataType.simpleString() == "array<float>"


def test_npy_round_trip_in_shards(spark, make, tmp_path):
    df = make.table([(i, [float(i), i / 2]) for i in range(300)], "node_id bigint, feat array<double>")
    path = str(tmp_path / "shards")
    arrays.write_npy(df.repartition(5), path, "<f8", order="node_id")
    got = arrays.read_npy(spark, path).orderBy("row").collect()
    assert [r.vals[0] for r in got] == [float(i) for i in range(300)]
    arrays.write_npy(df.repartition(5).select("feat"), str(tmp_path / "more"), "<f8")
    shards = sorted((tmp_path / "more").glob("*.npy"))
    assert len(shards) == 5 and sum(len(np.load(f)) for f in shards) == 300
    more = arrays.read_npy(spark, str(tmp_path / "more"), rows_per_task=7)
    assert sorted(r.row for r in more.collect()) == list(range(300))
    assert sorted(r.vals[0] for r in more.collect()) == [float(i) for i in range(300)]


def write_csr(prefix, pairs, n):
    pairs = sorted(pairs)
    offsets = np.zeros(n + 1, dtype="<u8")
    for a, _ in pairs:
        offsets[a + 1] += 1
    offsets = np.cumsum(offsets).astype("<u8")
    np.concatenate([np.array([n + 1, 0], "<u8"), offsets]).tofile(f"{prefix}.col")
    np.concatenate([np.array([len(pairs), 0], "<u8"), np.array([b for _, b in pairs], "<u8")]).tofile(f"{prefix}.dst")


def test_binary_csr(spark, tmp_path):
    pairs = hub_graph(60)
    write_csr(tmp_path / "g", pairs, 64)
    df = arrays.read_csr(spark, str(tmp_path / "g"), rows_per_task=23)
    assert df.rdd.getNumPartitions() > 2 and rows(df) == sorted(pairs)
    assert rows(tables.read_edges(spark, str(tmp_path / "g"), "csr")) == sorted(pairs)


def test_values_beyond_signed_range_are_refused(spark, tmp_path):
    np.save(tmp_path / "big.npy", np.array([[1, 2 ** 63]], dtype="<u8"))
    with pytest.raises(Exception, match="signed 64-bit"):
        arrays.read_npy_edges(spark, str(tmp_path / "big.npy")).collect()


def test_parquet_edges_and_export(spark, make, tmp_path):
    nodes = make.table([(0, 1, [1.0]), (1, None, [2.0])], "node_id bigint, label int, feat array<float>")
    writers.export_dataset(nodes, make.edges([(0, 1)]), str(tmp_path / "out"))
    assert rows(tables.read_edges(spark, str(tmp_path / "out/edges"))) == [(0, 1)]
    assert rows(tables.read_features(spark, str(tmp_path / "out/features")), "node_id") == [(0,), (1,)]


def test_striped_write_and_slice(spark, make, tmp_path):
    df = make.table([(i, [float(i)]) for i in range(40)], "node_id bigint, feat array<float>")
    writers.write_features(df, str(tmp_path / "s"), 4, by="node_id")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert all(n % 4 == s for n, s in rows(back, "node_id", "shard")) and back.count() == 40
    assert [r.node_id for r in tables.read_slice(df, 10, 5).collect()] == [10, 11, 12, 13, 14]


def test_bucketed_tables_join_without_an_exchange(spark, make, tmp_path):
    df = make.table([(i, [float(i)]) for i in range(100)], "node_id bigint, feat array<float>")
    index = make.table([(0, i, i % 100) for i in range(300)], "batch_id bigint, pos bigint, node_id bigint")
    writers.write_bucketed(df, "feat_bucketed", str(tmp_path / "f"), buckets=4)
    writers.write_bucketed(index, "index_bucketed", str(tmp_path / "i"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("index_bucketed").join(spark.table("feat_bucketed"), "node_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_npy_appends_keep_earlier_rows_and_overwrites_do_not(spark, make, tmp_path):
    path = str(tmp_path / "x")
    for base in (0, 2, 4):
        arrays.write_npy(make.table([(float(base + i),) for i in range(2)], "v double").coalesce(1), path, "<f8")
    got = arrays.read_npy(spark, path).orderBy("row").collect()
    assert [(r.row, r.vals[0]) for r in got] == [(i, float(i)) for i in range(6)]
    arrays.write_npy(make.table([(9.0,)], "v double"), path, "<f8", mode="overwrite")
    assert [r.vals[0] for r in arrays.read_npy(spark, path).collect()] == [9.0]


def test_npy_column_major(spark, tmp_path):
    x = np.asfortranarray(np.arange(60, dtype=np.float32).reshape(20, 3))
    np.save(tmp_path / "x.npy", x)
    got = arrays.read_npy(spark, str(tmp_path / "x.npy"), rows_per_task=7).orderBy("row").collect()
    assert np.allclose([r.vals for r in got], x)
    pairs = np.array(hub_graph(40), dtype="<i8")
    for data in (pairs, pairs.T):
        np.save(tmp_path / "e.npy", np.asfortranarray(data))
        assert rows(arrays.read_npy_edges(spark, str(tmp_path / "e.npy"), rows_per_task=11)) == sorted((int(a), int(b)) for a, b in pairs)


def test_wide_rows_make_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "TASK_BYTES", 8 * 1024 * 10)
    x = np.random.default_rng(1).normal(size=(35, 1024))
    np.save(tmp_path / "x.npy", x)
    df = arrays.read_npy(spark, str(tmp_path / "x.npy"))
    assert df.rdd.getNumPartitions() == 4
    assert np.allclose([r.vals for r in df.orderBy("row").collect()], x)


def test_rewritten_epoch_replaces_itself(spark, make, tmp_path):
    path = str(tmp_path / "trace")
    batch = make.table([(0, 0, 3), (0, 1, 4)], "batch_id bigint, pos bigint, node_id bigint")
    for epoch in (0, 1, 1):
        writers.write_trace(batch, path, epoch)
    assert spark.read.parquet(path).groupBy("epoch").count().orderBy("epoch").collect() == [(0, 2), (1, 2)]


def damage(folder, kept):
    """Make every shard but the kept ones unreadable."""
    for file in folder.glob("part-*"):
        if not any(file.name.startswith(k) for k in kept):
            file.write_bytes(b"")


def test_slice_opens_only_the_shards_of_its_range(spark, make, tmp_path):
    import json

    df = make.table([(i, [float(i), i / 2]) for i in range(300)], "node_id bigint, feat array<double>")
    for part in range(3):
        arrays.write_npy(df.filter(f"node_id DIV 100 = {part}").repartition(5), str(tmp_path), "<f8", order="node_id")
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    sizes = [e["shape"][0] for e in manifest]
    assert len(sizes) > 2 and sum(sizes) == 300
    low = sizes[0] + 3
    damage(tmp_path, [manifest[1]["name"]])
    feats = tables.read_features(spark, str(tmp_path), "npy")
    got = tables.read_slice(feats, low, 10).collect()
    assert [r.feat[0] for r in got] == [float(i) for i in range(low, low + 10)]
    assert feats.filter(f"node_id = {low} AND feat[0] >= 0").count() == 1
    assert feats.filter(f"node_id IN ({low}, {low + 5}, {low + 1})").count() == 3
    assert feats.filter(f"node_id > {low} AND node_id <= {low + 4}").count() == 4
    assert feats.filter("node_id < 0").count() == 0 and feats.filter("node_id = 1000").count() == 0


def test_pushed_filters_are_exact(spark, tmp_path):
    x = np.arange(50.0).reshape(50, 1)
    np.save(tmp_path / "x.npy", x)
    df = arrays.read_npy(spark, str(tmp_path / "x.npy"), rows_per_task=8)
    for condition in ("row >= 10 AND row < 20", "row = 7", "row IN (1, 40)", "row IS NULL", "row = 3 OR row = 30", "NOT row = 5", "row > 48",
                      "row = NULL", "row <=> 4", "row % 7 = 3 AND row < 30"):
        want = [r.id for r in spark.range(50).filter(condition.replace("row", "id")).orderBy("id").collect()]
        assert [r.row for r in df.filter(condition).orderBy("row").collect()] == want, condition
    assert df.filter("row BETWEEN 16 AND 23").rdd.getNumPartitions() == 1


def test_names_only_manifests_are_still_read(spark, tmp_path):
    import json

    for i in range(2):
        np.save(tmp_path / f"s{i}.npy", np.full((3, 2), float(i)))
    (tmp_path / "manifest.json").write_text(json.dumps(["s0.npy", "s1.npy"]))
    assert [(r.row, r.vals[0]) for r in arrays.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == [(i, float(i // 3)) for i in range(6)]


def test_csr_shards_round_trip(spark, make, tmp_path):
    pairs = hub_graph(90) + [(5000, 1), (5000, 2), (10**7, 3)]
    path = str(tmp_path / "g")
    arrays.write_csr(make.edges(pairs).repartition(3), path, shard_edges=20, shard_vertices=64)
    df = arrays.read_csr(spark, path, rows_per_task=9)
    assert rows(df) == sorted(pairs) and df.rdd.getNumPartitions() > 5
    assert rows(df.filter("src = 0")) == sorted(p for p in pairs if p[0] == 0)  # a hub goes over several shards
    assert rows(df.filter("src BETWEEN 60 AND 70")) == sorted(p for p in pairs if 60 <= p[0] <= 70)
    assert rows(df.filter("src > 4000 AND dst > 1")) == [(5000, 2), (10**7, 3)]
    assert df.filter("src = 1234").count() == 0
    arrays.write_csr(make.edges([(7, 7)]), path)
    assert rows(arrays.read_csr(spark, path)) == sorted([*pairs, (7, 7)])
    arrays.write_csr(make.edges([(1, 2)]), path, mode="overwrite")
    assert rows(tables.read_edges(spark, path, "csr")) == [(1, 2)]


def test_csr_filter_opens_only_the_shards_of_its_range(spark, make, tmp_path):
    import json

    pairs = [(i, j) for i in range(100) for j in range(3)]
    arrays.write_csr(make.edges(pairs), str(tmp_path), shard_edges=30)
    manifest = json.loads((tmp_path / "manifest.json").read_text())
    assert sum(e["edges"] for e in manifest) == 300 and len(manifest) >= 10
    shard = manifest[4]
    damage(tmp_path, [shard["name"]])
    inside = shard["first"] + 2
    assert rows(arrays.read_csr(spark, str(tmp_path)).filter(f"src = {inside}")) == [(inside, j) for j in range(3)]


def test_empty_csr_and_negative_ids(spark, make, tmp_path):
    arrays.write_csr(make.edges([(1, 2)]).limit(0), str(tmp_path / "none"))
    assert arrays.read_csr(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="negative"):
        arrays.write_csr(make.edges([(-1, 2)]), str(tmp_path / "bad"))


def test_block_nodes(spark, make, tmp_path):
    block = make.table([(0, 1, 5, 6), (0, 1, 6, 7), (1, 1, 5, 6)], "batch_id bigint, layer bigint, src bigint, dst bigint")
    seeds = make.table([(1, 1, 9)], "batch_id bigint, layer bigint, node_id bigint")
    for _ in range(2):  # a second run replaces the epoch
        writers.write_block_nodes(block, str(tmp_path / "n"), 3, seeds)
    back = spark.read.parquet(str(tmp_path / "n")).select("epoch", "layer", "batch_id", "node_id", "is_dst")
    assert rows(back) == [(3, 1, 0, 5, False), (3, 1, 0, 6, True), (3, 1, 0, 7, True), (3, 1, 1, 5, False), (3, 1, 1, 6, True), (3, 1, 1, 9, True)]
