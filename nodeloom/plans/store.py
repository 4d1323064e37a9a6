"""Written tables that cut lineage.

Iterative jobs write each round as Parquet in the shared folder the cluster names in
``spark.checkpoint.dir``. Reading it back survives the loss of any executor, keeps
column pruning, and gives the optimiser true sizes for its broadcast decisions.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Delete the shuffle files of a query once it has ended, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    Taken from the session; only a master that runs everything in one process gets a folder of
    its own when the setting is absent, because a machine-local path is useless to other executors.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING, None)
    folder = folder or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {SETTING} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="nodeloom-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/nodeloom-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@dataclass
class Saved:
    """A written table: its DataFrame, row count and place."""

    df: DataFrame
    rows: int
    path: str
    table: str | None = None

    def drop(self) -> None:
        """Delete the files and the catalog entry; call only when nothing lazy still reads them."""
        spark = self.df.sparkSession
        if self.table:
            spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        place.getFileSystem(conf).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in the block leave no shuffle files: the written table is all that is read later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def write_counted(df: DataFrame, path: str, **measures: Column) -> dict:
    """Write ``df`` and return its row count ``n`` and the ``measures`` from the same job."""
    seen = Observation()
    with shuffles_dropped(df.sparkSession):
        df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in measures.items()]).write.parquet(path)
    return seen.get


class Parts:
    """A written table that grows: every ``add`` writes one more part, ``df`` reads all of them.

    Of every level of parts ``FAN`` are merged into one of the next level, so a table of r parts is
    read from a few files per level and a row is written again log(r) times. The newest part stays
    alone until the next one is written.
    """

    FAN = 16

    def __init__(self, blank: DataFrame, name: str):
        self.blank, self.name = blank, name
        self.schema, self.spark = blank.schema, blank.sparkSession
        self.levels: list[list[Saved]] = [[]]
        self.written = self.merged = 0  # rows added, rows written again by merging

    def _load(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, df: DataFrame, **measures: Column) -> tuple[Saved, dict]:
        path = fresh_path(self.spark, self.name)
        seen = write_counted(df, path, **measures)
        return Saved(self._load(path), int(seen["n"]), path), seen

    def add(self, df: DataFrame, **measures: Column) -> dict:
        """Append the rows of ``df``, which may read this table; the count ``n`` and ``measures``."""
        part, seen = self._write(df, **measures)
        self.written += part.rows
        self._merge()
        self.levels[0].append(part)
        return seen

    def _merge(self) -> None:
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.FAN:
                old = self.levels[i]
                together, _ = self._write(self._load(*(p.path for p in old)))
                self.merged += together.rows
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(together)
                for p in old:
                    p.drop()

    @property
    def rows(self) -> int:
        return sum(p.rows for level in self.levels for p in level)

    @property
    def newest(self) -> DataFrame:
        return self.levels[0][-1].df

    @property
    def df(self) -> DataFrame:
        paths = [p.path for level in self.levels for p in level if p.rows]
        return self._load(*paths) if paths else self.blank.limit(0)

    def drop(self) -> None:
        for level in self.levels:
            for p in level:
                p.drop()
        self.levels = [[]]


def save(df: DataFrame, name: str = "table") -> Saved:
    """Write ``df`` once and read it back; the row count comes from the same job."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    seen = write_counted(df, path)
    return Saved(spark.read.schema(df.schema).parquet(path), int(seen["n"]), path)


ROWS_PER_BUCKET = 8_000_000
#: Spark refuses more than 100,000 buckets; beyond this many they grow in size instead, and a
#: bucket is still a bounded share of the table.
MAX_BUCKETS = 65_536


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of narrow rows, 0 when it is too small to profit.

    At least as many as shuffle partitions, or a join would rather shuffle both sides.
    """
    if rows < 2 * ROWS_PER_BUCKET:
        return 0
    wanted = max(-(-rows // ROWS_PER_BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(wanted, MAX_BUCKETS)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> Saved:
    """Write ``df`` hashed into buckets by ``keys``: later joins on them leave it in place."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"nodeloom_{name}_{uuid.uuid4().hex[:12]}"
    seen = Observation()
    with shuffles_dropped(spark):
        (df.repartition(buckets, *keys).observe(seen, F.count(F.lit(1)).alias("n"))
         .write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return Saved(spark.table(table), int(seen.get["n"]), path, table)


_SCRATCH: ContextVar[list[Saved] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    saved = save(df, name)
    if (scratch := _SCRATCH.get()) is not None:
        scratch.append(saved)
    return saved.df


def save_last(build: Callable[[], DataFrame], name: str) -> Saved:
    """The written result of ``build``; the tables that it materialized on the way are deleted."""
    scratch: list[Saved] = []
    token = _SCRATCH.set(scratch)
    try:
        result = save(build(), name)
    finally:
        _SCRATCH.reset(token)
    for table in scratch:
        table.drop()
    return result
