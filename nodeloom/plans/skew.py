"""Explicit spreading of hot join keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.plans.store import Saved, bucket_count, save, save_bucketed


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Before it has run anything, Spark compares the bytes of the files with its threshold. Vectors stored by
    dictionary, or rows that an ``explode`` makes, can be a hundred times larger in memory, and a broadcast passes
    through the driver. A sort-merge join holds neither side and can still be split where a key is hot.
    """
    return df.hint("merge")


HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


@contextmanager
def hashed_joins(spark: SparkSession, size: str = "64m") -> Iterator[None]:
    """Joins that run in the block hash a side whose shuffled partitions all turn out to be at most ``size``.

    The other side, usually all edges, is then not sorted. Spark decides by the sizes it has measured, and still
    cuts up hot keys of the other side.
    """
    before = spark.conf.get(HASHED, None)
    spark.conf.set(HASHED, size)
    try:
        yield
    finally:
        spark.conf.unset(HASHED) if before is None else spark.conf.set(HASHED, before)


@dataclass
class SpreadTable:
    """A written table whose hot keys are cut into salted shares.

    ``hot`` maps a hot key to its number of shares and is None when no key is hot. Spark's own
    threshold decides whether the map is broadcast.
    """

    saved: Saved
    key: str
    hot: DataFrame | None
    hot_table: Saved | None = None

    def drop(self) -> None:
        """Delete the files; call only when nothing lazy still reads them."""
        self.saved.drop()
        if self.hot_table:
            self.hot_table.drop()

    def join(self, other: DataFrame) -> DataFrame:
        """Inner join on the key. ``other`` rows of hot keys are repeated once per share."""
        if self.hot is None:
            return self.saved.df.join(other, self.key)
        shares = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
        spread = other.join(self.hot, self.key, "left").withColumn("_salt", F.explode(shares))
        return self.saved.df.join(spread.drop("_shares"), [self.key, "_salt"]).drop("_salt")


#: Rows of one key a single task should read at most.
KEY_ROWS = 1_000_000


def spread(df: DataFrame, key: str, *, key_rows: int = KEY_ROWS) -> SpreadTable:
    """Write ``df`` once for many joins on ``key``, every key above ``key_rows`` rows cut up.

    The limit is what one task should read, whatever the size of the table; the map of hot keys
    has at most total / ``key_rows`` rows. A large table is written in buckets of its join
    columns, so the rounds that follow never shuffle it again.
    """
    plain = save(df, "edges")
    limit = key_rows
    buckets = bucket_count(df.sparkSession, plain.rows)
    kept = _hot_keys(plain.df, key, limit) if plain.rows >= limit else None
    hot = kept.df if kept else None
    if hot is None and not buckets:
        return SpreadTable(plain, key, None)
    table, keys = plain.df, [key]
    if hot is not None:
        others = [c for c in df.columns if c != key]
        salt = F.pmod(F.xxhash64(*others), F.coalesce("_shares", F.lit(1)).cast("bigint")).cast("int")
        table = table.join(hot, key, "left").withColumn("_salt", salt).drop("_shares")
        keys = [key, "_salt"]
    spreaded = save_bucketed(table, "spread", keys, buckets) if buckets else save(table, "spread")
    plain.drop()
    return SpreadTable(spreaded, key, hot, kept)


def _hot_keys(df: DataFrame, key: str, limit: int) -> Saved | None:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = save(counts.select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_shares")), "hot")
    if not hot.rows:
        hot.drop()
        return None
    return hot
