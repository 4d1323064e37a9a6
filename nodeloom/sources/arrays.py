"""Array files as Spark sources and sinks: ``.npy`` and binary CSR.

A partition is a range of rows of the fixed-width body; tasks seek to it and read only
that. Filters on the row number (``npy``) or on ``src`` (``csr``) narrow the ranges, and the manifest of a
sharded folder tells what each shard holds, so other shards are not even opened. Paths may be plain (a
shared mount) or any URI Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

ROWS_PER_TASK = 4_000_000
BATCH = 65_536
#: Bytes a task and a batch read at most, whatever the width of a row.
TASK_BYTES, BATCH_BYTES = 256 << 20, 16 << 20
#: Edges of a CSR shard and ids of a block that a shard lies in, at most.
SHARD_EDGES, SHARD_VERTICES = 4_000_000, 4_000_000


def _fitting(rows: int, limit: int, row_bytes: int) -> int:
    """``rows``, or as many as ``limit`` bytes hold."""
    return max(1, min(rows, limit // max(row_bytes, 1)))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class _Header:
    path: str
    shape: tuple[int, ...]
    dtype: str
    fortran: bool
    start: int


def _npy_header(path: str) -> _Header:
    system, place = _open(path)
    with system.open_input_file(place) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        return _Header(path, shape, dtype.str, fortran, f.tell())


def _manifest(path: str) -> list | None:
    """The shards that a folder's manifest names in order, None for a plain file."""
    system, place = _open(path)
    if system.get_file_info(place).type != pafs.FileType.Directory:
        return None
    with system.open_input_file(f"{place}/manifest.json") as f:
        return json.loads(f.read())


def _extend_manifest(path: str, entries: list, overwrite: bool) -> None:
    if not overwrite and _open(path)[0].get_file_info(f"{_open(path)[1]}/manifest.json").type == pafs.FileType.File:
        entries = (_manifest(path) or []) + entries
    system, place = _open(path)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/manifest.json") as sink:
        sink.write(json.dumps(entries).encode())


def _npy_headers(path: str) -> list[_Header]:
    """Headers of the file or of a folder's shards; only shards that the manifest merely names are opened."""
    entries = _manifest(path)
    if entries is None:
        return [_npy_header(path)]
    folder = path.rstrip("/")
    return [_npy_header(f"{folder}/{e}") if isinstance(e, str)
            else _Header(f"{folder}/{e['name']}", tuple(e["shape"]), e["dtype"], False, e["start"]) for e in entries]


@dataclass
class _Span:
    """An inclusive range of one integer column, narrowed by filters."""

    column: str
    low: int = -(1 << 63)
    high: int = (1 << 63) - 1

    def take(self, filters: list[Filter]) -> list[Filter]:
        """Narrow the range; Spark still evaluates every filter on the rows that are read."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,):
                continue
            if isinstance(f, In):
                values = [v for v in f.value if v is not None]
                self._cut(min(values, default=1), max(values, default=0))
            elif getattr(f, "value", None) is None:
                continue
            elif isinstance(f, EqualTo):
                self._cut(f.value, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._cut(f.value + isinstance(f, GreaterThan), self.high)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._cut(self.low, f.value - isinstance(f, LessThan))
        return filters

    def _cut(self, low: int, high: int) -> None:
        self.low, self.high = max(self.low, low), min(self.high, high)

    def within(self, first: int, count: int) -> tuple[int, int]:
        """The part of ``count`` values from ``first`` on that lies in the range, as offsets from ``first``."""
        return max(self.low - first, 0), min(self.high - first + 1, count)


def _read_span(f, start: int, count: int, dtype: np.dtype) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(count * dtype.itemsize), dtype=dtype)


@dataclass
class _Rows(InputPartition):
    header: _Header
    begin: int
    end: int
    base: int
    wide: bool


def _checked_longs(values: np.ndarray) -> np.ndarray:
    if values.dtype.kind == "u" and values.dtype.itemsize == 8 and len(values) and values.max() >> np.uint64(63):
        raise ValueError("unsigned value beyond the signed 64-bit range")
    return values.astype(np.int64)


class NpyReader(DataSourceReader):
    """Rows (row, vals) of an array, or the first two columns as edges."""

    def __init__(self, path: str, edges: bool, rows_per_task: int):
        self.path, self.edges, self.rows_per_task = path, edges, rows_per_task
        self.span = _Span("row")

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self.span.take(filters)

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        base = 0
        for header in _npy_headers(self.path):
            if self.edges and header.fortran and len(header.shape) == 2:
                # Two columns by column are the same bytes as two rows by row.
                header = _Header(header.path, header.shape[::-1], header.dtype, False, header.start)
            wide = self.edges and len(header.shape) == 2 and header.shape[0] == 2
            rows = header.shape[1] if wide else header.shape[0]
            width = 2 if wide else int(np.prod(header.shape[1:], dtype=np.int64))
            step = _fitting(self.rows_per_task, TASK_BYTES, 8 * width)
            low, high = self.span.within(base, rows)
            for begin in range(low, high, step):
                parts.append(_Rows(header, begin, min(begin + step, high), base + begin, wide))
            base += rows
        return parts or [_Rows(_Header(self.path, (0,), "<i8", False, 0), 0, 0, 0, False)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        head = part.header
        dtype = np.dtype(head.dtype)
        system, place = _open(head.path)
        with system.open_input_file(place) as f:
            width = int(np.prod(head.shape[1:], dtype=np.int64)) if len(head.shape) > 1 else 1
            size = BATCH if part.wide else _fitting(BATCH, BATCH_BYTES, 8 * width)
            for begin in range(part.begin, part.end, size):
                n = min(size, part.end - begin)
                if part.wide:
                    src = _read_span(f, head.start + begin * dtype.itemsize, n, dtype)
                    dst = _read_span(f, head.start + (head.shape[1] + begin) * dtype.itemsize, n, dtype)
                else:
                    if head.fortran and width > 1:
                        places = (head.start + (c * head.shape[0] + begin) * dtype.itemsize for c in range(width))
                        block = np.stack([_read_span(f, place, n, dtype) for place in places], axis=1)
                    else:
                        block = _read_span(f, head.start + begin * width * dtype.itemsize, n * width, dtype).reshape(n, width)
                    if not self.edges:
                        ids = np.arange(part.base + begin - part.begin, part.base + begin - part.begin + n)
                        flat = pa.array(block.astype(np.float64).ravel())
                        offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids), pa.ListArray.from_arrays(offsets, flat)], ["row", "vals"])
                        continue
                    src, dst = block[:, 0], block[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(_checked_longs(src)), pa.array(_checked_longs(dst))], ["src", "dst"])


@dataclass
class _Written(WriterCommitMessage):
    """What one task wrote: the manifest's entries and the files they stand for."""

    task: int
    entries: list
    files: list[str]


def _abort(path: str, messages: list[WriterCommitMessage | None]) -> None:
    """Remove the shards of a failed job."""
    system, place = _open(path)
    for message in messages:
        for name in message.files if message is not None else []:
            system.delete_file(f"{place}/{name}")


def _commit(path: str, messages: list[WriterCommitMessage | None], overwrite: bool) -> None:
    done = sorted((m for m in messages if m is not None), key=lambda m: m.task)
    _extend_manifest(path, [e for m in done for e in m.entries], overwrite)


class NpyWriter(DataSourceArrowWriter):
    """One shard per task; the commit adds them to the folder's manifest (or replaces it when
    overwriting), so shards of lost or repeated tasks are never read."""

    def __init__(self, path: str, dtype: str, overwrite: bool = False):
        self.path, self.dtype, self.overwrite, self.job = path, dtype, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import io

        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}.npy"
        system, place = _open(self.path)
        system.create_dir(place, recursive=True)
        dtype, rows, width = np.dtype(self.dtype), 0, 0
        # The header has a fixed length, so it is written again once the row count is known.
        body = f"{place}/{name}.body"
        with system.open_output_stream(body) as sink:
            for batch in batches:
                block = _to_matrix(batch, dtype)
                if len(block):
                    rows, width = rows + len(block), block.shape[1]
                    sink.write(np.ascontiguousarray(block).tobytes())
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": dtype.str, "fortran_order": False, "shape": (rows, width)})
        with system.open_output_stream(f"{place}/{name}") as sink, system.open_input_stream(body) as source:
            sink.write(head.getvalue())
            while chunk := source.read(1 << 24):
                sink.write(chunk)
        system.delete_file(body)
        entry = {"name": name, "shape": [rows, width], "dtype": dtype.str, "start": len(head.getvalue())}
        return _Written(context.partitionId(), [entry] if rows else [], [name])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _commit(self.path, messages, self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _abort(self.path, messages)


def _to_matrix(batch: pa.RecordBatch, dtype: np.dtype) -> np.ndarray:
    """Scalar columns side by side, or one list column as rows."""
    first = batch.column(0)
    if pa.types.is_list(first.type):
        if len(first) == 0:
            return np.zeros((0, 0), dtype)
        return first.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(first), -1)
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(dtype) for c in batch.columns])


class NpySource(DataSource):
    """``npy``: options ``path``, ``kind`` (rows or edges), ``dtype`` (writing), ``rows_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "src bigint, dst bigint" if self.options.get("kind") == "edges" else "row bigint, vals array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpyReader(self.options["path"], self.options.get("kind") == "edges",
                         int(self.options.get("rows_per_task", ROWS_PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NpyWriter(self.options["path"], self.options.get("dtype", "<i8"), overwrite)


@dataclass
class _CsrShard:
    """``<prefix>.col`` and ``<prefix>.dst``: the lists of ``vertices`` vertices from ``first`` on."""

    prefix: str
    first: int
    vertices: int
    edges: int


@dataclass
class _EdgeSpan(InputPartition):
    shard: _CsrShard | None
    begin: int
    end: int


HEADER = 16
_U8 = np.dtype("<u8")


def _count(path: str) -> int:
    system, place = _open(path)
    with system.open_input_file(place) as f:
        return int(_read_span(f, 0, 1, _U8)[0])


def _csr_shards(path: str) -> list[_CsrShard]:
    system, place = _open(path)
    if system.get_file_info(place).type != pafs.FileType.Directory:
        return [_CsrShard(path, 0, _count(path + ".col") - 1, _count(path + ".dst"))]
    return [_CsrShard(f"{path.rstrip('/')}/{e['name']}", e["first"], e["vertices"], e["edges"]) for e in _manifest(path) or []]


class CsrReader(DataSourceReader):
    """Binary CSR: ``<prefix>.col`` and ``<prefix>.dst``, each a 16-byte header (count, type) followed by unsigned
    64-bit offsets / destinations; or a folder of such pairs whose manifest is an index over the vertices.

    A filter on ``src`` picks the shards by the index and the edges by two offsets.
    """

    def __init__(self, path: str, rows_per_task: int):
        self.path, self.rows_per_task, self.span = path, rows_per_task, _Span("src")

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        return self.span.take(filters)

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for shard in _csr_shards(self.path):
            low, high = self.span.within(shard.first, shard.vertices)
            if low >= high:
                continue
            begin, end = 0, shard.edges
            if (low, high) != (0, shard.vertices):
                system, place = _open(shard.prefix + ".col")
                with system.open_input_file(place) as f:
                    begin, end = (int(_read_span(f, HEADER + 8 * v, 1, _U8)[0]) for v in (low, high))
            parts += [_EdgeSpan(shard, b, min(b + self.rows_per_task, end)) for b in range(begin, end, self.rows_per_task)]
        return parts or [_EdgeSpan(None, 0, 0)]

    def _owner(self, f, vertices: int, edge: int) -> int:
        """The vertex whose list holds the edge: the last offset not beyond it, by bisection in the file."""
        low, high = 0, vertices
        while low < high:
            mid = (low + high + 1) // 2
            if int(_read_span(f, HEADER + 8 * mid, 1, _U8)[0]) <= edge:
                low = mid
            else:
                high = mid - 1
        return low

    def read(self, part: _EdgeSpan) -> Iterator[pa.RecordBatch]:
        shard = part.shard
        if shard is None:
            return
        (s1, p1), (s2, p2) = _open(shard.prefix + ".col"), _open(shard.prefix + ".dst")
        with s1.open_input_file(p1) as col, s2.open_input_file(p2) as body:
            for begin in range(part.begin, part.end, BATCH):
                n = min(BATCH, part.end - begin)
                first, last = self._owner(col, shard.vertices, begin), self._owner(col, shard.vertices, begin + n - 1)
                offsets = _checked_longs(_read_span(col, HEADER + 8 * first, last - first + 2, _U8))
                ordinals = np.arange(begin, begin + n)
                src = shard.first + first + np.searchsorted(offsets, ordinals, side="right") - 1
                dst = _checked_longs(_read_span(body, HEADER + 8 * begin, n, _U8))
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(dst)], ["src", "dst"])


class CsrWriter(DataSourceArrowWriter):
    """Shards of sorted edges, several a task: a shard has at most ``shard_edges`` edges and lies in one
    block of ``shard_vertices`` ids, which bounds what a task holds. A vertex may go on in the next shard.

    The commit adds the shards to the folder's manifest, so those of lost or repeated tasks are never read.
    Ids should be dense: a block with few edges costs a shard of its own.
    """

    def __init__(self, path: str, shard_edges: int, shard_vertices: int, overwrite: bool):
        self.path, self.shard_edges, self.shard_vertices, self.overwrite = path, shard_edges, shard_vertices, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        stem = f"part-{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}"
        done = _Written(context.partitionId(), [], [])
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            if size:
                self._shard(f"{stem}-{len(done.entries):05d}", np.concatenate(held, axis=1), done)
            held, size = [], 0

        for batch in batches:
            edges = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
            if edges.size and edges.min() < 0:
                raise ValueError("binary CSR holds no negative ids")
            cuts = np.flatnonzero(np.diff(edges[0] // self.shard_vertices)) + 1
            for piece in np.split(edges, cuts, axis=1):
                if size and piece.shape[1] and held[-1][0, -1] // self.shard_vertices != piece[0, 0] // self.shard_vertices:
                    flush()
                while piece.shape[1]:
                    take = piece[:, :self.shard_edges - size]
                    held.append(take)
                    size += take.shape[1]
                    piece = piece[:, take.shape[1]:]
                    if size == self.shard_edges:
                        flush()
        flush()
        return done

    def _shard(self, name: str, edges: np.ndarray, done: _Written) -> None:
        src, dst = edges
        first, vertices = int(src[0]), int(src[-1] - src[0]) + 1
        offsets = np.concatenate([[0], np.cumsum(np.bincount(src - first, minlength=vertices))])
        system, place = _open(self.path)
        system.create_dir(place, recursive=True)
        for suffix, values in ((".col", offsets), (".dst", dst)):
            done.files.append(name + suffix)
            with system.open_output_stream(f"{place}/{name}{suffix}") as sink:
                sink.write(np.array([len(values), 0], _U8).tobytes())
                sink.write(values.astype(_U8).tobytes())
        done.entries.append({"name": name, "first": first, "vertices": vertices, "edges": len(dst)})

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _commit(self.path, messages, self.overwrite)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _abort(self.path, messages)


class CsrSource(DataSource):
    """``csr``: options ``path``, ``rows_per_task``, and for writing ``shard_edges`` and ``shard_vertices``."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CsrReader(self.options["path"], int(self.options.get("rows_per_task", ROWS_PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return CsrWriter(self.options["path"], int(self.options.get("shard_edges", SHARD_EDGES)),
                         int(self.options.get("shard_vertices", SHARD_VERTICES)), overwrite)


def _register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def read_npy(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(row, vals): each row of the array with its ordinal."""
    _register(spark, NpySource)
    return spark.read.format("npy").option("rows_per_task", rows_per_task).load(path)


def read_npy_edges(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    _register(spark, NpySource)
    return spark.read.format("npy").option("kind", "edges").option("rows_per_task", rows_per_task).load(path)


def read_csr(spark: SparkSession, prefix: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(src, dst) of a pair of files or of a folder of shards; a filter on ``src`` reads its lists only."""
    _register(spark, CsrSource)
    return spark.read.format("csr").option("rows_per_task", rows_per_task).load(prefix)


def write_npy(df: DataFrame, path: str, dtype: str = "<i8", order: str | None = None, mode: str = "append") -> None:
    """A folder of ``.npy`` shards; with ``order`` the shards together are sorted by that column,
    which is dropped. Appending keeps the rows of earlier writes and puts the new ones after them."""
    _register(df.sparkSession, NpySource)
    if order is not None:
        df = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order)
    df.write.format("npy").option("dtype", dtype).mode(mode).save(path)


def write_csr(df: DataFrame, path: str, mode: str = "append", shard_edges: int = SHARD_EDGES, shard_vertices: int = SHARD_VERTICES) -> None:
    """A folder of binary CSR shards of (src, dst). The edges are range-sorted, so a hub's list is cut over tasks;
    appending adds shards beside the earlier ones."""
    _register(df.sparkSession, CsrSource)
    edges = df.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).repartitionByRange("src", "dst")
    (edges.sortWithinPartitions("src", "dst").write.format("csr").option("shard_edges", shard_edges)
     .option("shard_vertices", shard_vertices).mode(mode).save(path))
