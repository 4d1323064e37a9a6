import os
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from nodeloom.operators import access, gather
from nodeloom.streaming import feeds
from tests.conftest import rows

TRACE = "batch_id bigint, pos bigint, node_id bigint"


def batches(make, tmp_path, parts=4):
    trace = make.table([(b, p, (b * 3 + p * p) % 11 if p % 3 else 0) for b in range(12) for p in range(9)], TRACE)
    for i in range(parts):
        trace.filter(F.col("batch_id") % parts == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return trace


def test_streamed_gather_equals_batch_gather(spark, make, tmp_path):
    trace = batches(make, tmp_path)
    feats = make.table([(i, [float(i)]) for i in range(11)], "node_id bigint, feat array<float>")
    stream = feeds.file_stream(spark, str(tmp_path / "in"), trace.schema)
    got = feeds.run_to_table(feeds.stream_gather(stream, feats))
    assert rows(got, "batch_id", "pos", "feat") == rows(gather.gather_features(trace, feats), "batch_id", "pos", "feat")


def test_running_frequency_equals_batch_frequency(spark, make, tmp_path):
    trace = batches(make, tmp_path)
    stream = feeds.file_stream(spark, str(tmp_path / "in"), trace.schema)
    updates = feeds.run_to_table(feeds.stream_batch_frequency(stream), "update")
    assert updates.select("epoch").distinct().count() == 4
    assert rows(feeds.latest(updates, ["node_id"], ["n_batches"])) == rows(access.access_frequency(trace))
    assert rows(feeds.run_batch_frequency(stream)) == rows(access.access_frequency(trace))
    total = feeds.latest(feeds.run_to_table(feeds.stream_frequency(stream), "update"), ["node_id"], ["n"])
    assert rows(total) == rows(trace.groupBy("node_id").count())


def test_late_rows_are_left_out_of_closed_windows(spark, make, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, node_id bigint"
    # The last file is late: by then two triggers have seen the fifth hour.
    minutes = [(1, 2, 61), (300,), (301,), (3,)]
    target = tmp_path / "in"
    target.mkdir()
    for i, part in enumerate(minutes):
        table = make.table([(start + timedelta(minutes=m), 1) for m in part], schema).coalesce(1)
        table.write.parquet(str(tmp_path / f"tmp{i}"))
        written = next((tmp_path / f"tmp{i}").glob("*.parquet"))
        shutil.copy(written, target / f"{i}.parquet")
        os.utime(target / f"{i}.parquet", (1700000000 + i, 1700000000 + i))
    stream = feeds.file_stream(spark, str(target), make.table([], schema).schema)
    updates = feeds.run_to_table(feeds.stream_windowed_frequency(stream, "1 hour", "30 minutes"), "update")
    got = rows(feeds.latest(updates, ["window_start", "node_id"], ["n"]), "window_start", "n")
    assert got == [(start, 2), (start + timedelta(hours=1), 1), (start + timedelta(hours=5), 2)]


def test_unordered_files_lose_no_row_and_late_ones_are_told(spark, make, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "ts timestamp, node_id bigint"
    target = tmp_path / "in"
    target.mkdir()
    for i, part in enumerate([(1, 2, 61), (300,), (301, 62), (3, 299)]):
        make.table([(start + timedelta(minutes=m), 1) for m in part], schema).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        shutil.copy(next((tmp_path / f"t{i}").glob("*.parquet")), target / f"{i}.parquet")
        os.utime(target / f"{i}.parquet", (1700000000 + i, 1700000000 + i))
    stream = feeds.file_stream(spark, str(target), make.table([], schema).schema)
    got = rows(feeds.run_windowed_frequency(stream, "1 hour", "30 minutes"), "window_start", "n", "n_late")
    hour = lambda h: start + timedelta(hours=h)
    assert got == [(hour(0), 3, 1), (hour(1), 2, 1), (hour(4), 1, 0), (hour(5), 2, 0)]


def write_in_order(make, folder, parts, schema):
    """One file per part, read in this order."""
    folder.mkdir()
    for i, part in enumerate(parts):
        make.table(part, schema).coalesce(1).write.parquet(str(folder.parent / f"{folder.name}-{i}"))
        shutil.copy(next((folder.parent / f"{folder.name}-{i}").glob("*.parquet")), folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1700000000 + i, 1700000000 + i))


def state_rows(stream, folder):
    """Rows in the first stateful operator after every trigger."""
    query = (stream.writeStream.option("checkpointLocation", str(folder)).outputMode("update").trigger(availableNow=True)
             .foreachBatch(lambda df, epoch: df.write.format("noop").mode("overwrite").save()).start())
    query.awaitTermination()
    return [[s.numRowsTotal for s in p.stateOperators] for p in query.recentProgress]


def test_state_of_open_batches_stays_flat(spark, make, tmp_path):
    nodes = 5
    parts = [[(t, p, p % nodes) for p in range(8)] for t in range(20)]
    write_in_order(make, tmp_path / "in", parts, TRACE)
    stream = feeds.file_stream(spark, str(tmp_path / "in"), make.table([], TRACE).schema)
    bounded = state_rows(feeds.stream_batch_frequency(stream, open_batches=3), tmp_path / "a")
    assert len(bounded) >= 20
    pairs = [max(s) for s in bounded]
    assert max(pairs) <= 8 * nodes and max(pairs[10:]) <= max(pairs[:10])
    updates = feeds.run_to_table(feeds.stream_batch_frequency(stream, open_batches=3), "update")
    assert rows(feeds.latest(updates, ["node_id"], ["n_batches"])) == [(n, 20) for n in range(nodes)]


def test_no_trigger_reads_what_others_wrote(spark, make, tmp_path, monkeypatch):
    """A trigger of the windowed count opens one row of the one before, whatever has been written."""
    start = datetime(2024, 1, 1)
    parts = [[(start + timedelta(hours=t, minutes=m), 1) for m in range(3)] for t in range(6)] + [[(start, 1)]]
    write_in_order(make, tmp_path / "in", parts, "ts timestamp, node_id bigint")
    stream = feeds.file_stream(spark, str(tmp_path / "in"), make.table([], "ts timestamp, node_id bigint").schema)
    made, read = [], []
    monkeypatch.setattr(feeds, "fresh_path", lambda s, name: made.append(str(tmp_path / name)) or made[-1])
    original = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **kw: read.extend(paths) or original(self, *paths, **kw))
    got = rows(feeds.run_windowed_frequency(stream, "1 hour", "30 minutes"), "window_start", "n", "n_late")
    assert got == [(start, 4, 1)] + [(start + timedelta(hours=h), 3, 0) for h in range(1, 6)]
    out = str(tmp_path / "windows")
    assert [p for p in read if p.startswith(out)] == [f"{out}-mark/{i}" for i in range(6)] + [out]


def test_batch_counts_in_any_order_keep_no_state(spark, make, tmp_path):
    parts = [[(3, 0, 7)], [(0, 0, 7), (3, 1, 7)], [(0, 1, 7), (1, 0, 8)], [(3, 2, 8)]]
    write_in_order(make, tmp_path / "in", parts, TRACE)
    stream = feeds.file_stream(spark, str(tmp_path / "in"), make.table([], TRACE).schema)
    assert rows(feeds.run_batch_frequency(stream)) == [(7, 2), (8, 2)]
