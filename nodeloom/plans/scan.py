"""Running totals and ranks without a one-task window.

A window with no partition key (or with one hot key) sends everything to one task.
Here rows are cut into blocks of bounded size, each block is scanned on its own, and
the block totals, which are few, are scanned and added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from nodeloom.plans.store import save

BLOCK = 1 << 16  # top level of three: 2**48 index values before it holds more rows
_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, 0)


def _block_offsets(blocks: DataFrame, block: str, total: str) -> DataFrame:
    """Exclusive running total over block sums: (block, _off). Two more levels of blocks."""
    sup = F.floor(F.col(block) / F.lit(BLOCK)).cast("bigint")
    blocks = blocks.withColumn("_sup", sup)
    inner = blocks.withColumn(
        "_in", F.sum(total).over(W.partitionBy("_sup").orderBy(block).rowsBetween(*_BEFORE))
    )
    top = blocks.groupBy("_sup").agg(F.sum(total).alias("_t"))
    # One row per super-block: the index range divided by BLOCK**2.
    top = top.select(
        "_sup", F.sum("_t").over(W.orderBy("_sup").rowsBetween(*_BEFORE)).alias("_base")
    )
    joined = inner.join(top, "_sup")
    off = F.coalesce("_in", F.lit(0)) + F.coalesce("_base", F.lit(0))
    return joined.select(F.col(block), off.alias("_off"))


def prefix_scan(
    df: DataFrame, index: str, value: str, out: str = "running", *,
    inclusive: bool = True, block: int = BLOCK,
) -> DataFrame:
    """Running total of ``value`` in order of the unique integer column ``index``.

    A block covers ``block`` consecutive index values, so no task ever holds more rows
    than that, however the values are spread.
    """
    cut = df.withColumn("_blk", F.floor(F.col(index) / F.lit(block)).cast("bigint"))
    sums = cut.groupBy("_blk").agg(F.sum(value).alias("_s"))
    frame = _UP_TO if inclusive else _BEFORE
    local = cut.withColumn(
        "_local", F.sum(value).over(W.partitionBy("_blk").orderBy(index).rowsBetween(*frame))
    )
    joined = local.join(_block_offsets(sums, "_blk", "_s"), "_blk")
    total = F.coalesce("_local", F.lit(0)) + F.col("_off")
    return joined.withColumn(out, total).select(*df.columns, out)


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """0-based position of each row in the total order ``order`` (which must break ties).

    One range shuffle. The sorted rows are written, since the range bounds come from a
    sample and must not be drawn twice; the partition sizes (one row per partition) are
    scanned and broadcast.
    """
    tagged = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    saved = save(tagged, "rank").df
    saved = saved.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = saved.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off")
    )
    ranked = saved.join(F.broadcast(offsets), "_part")
    return ranked.withColumn(out, (F.col("_off") + F.col("_pos")).cast("bigint")).select(*df.columns, out)


def block_digits(rows: int, block: int = BLOCK) -> int:
    """Leading hex digits that cut ``rows`` uniform digests into blocks of at most about ``block``."""
    digits = 2
    while rows > block * 16 ** digits:
        digits += 1
    return digits


def hash_rank(df: DataFrame, hex_col: str, tie: str, out: str = "rank", digits: int | None = None) -> DataFrame:
    """0-based rank by a uniform hex digest, ties by ``tie``; no sampling, no written table.

    The leading ``digits`` hex digits are the block: uniform by construction, so blocks
    are even. Their number follows from the row count unless it is given.
    """
    if digits is None:
        digits = block_digits(df.count())
    block = F.conv(F.substring(F.col(hex_col), 1, digits), 16, 10).cast("bigint")
    cut = df.withColumn("_blk", block)
    sums = cut.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    local = cut.withColumn("_rn", F.row_number().over(W.partitionBy("_blk").orderBy(hex_col, tie)))
    joined = local.join(_block_offsets(sums, "_blk", "_n"), "_blk")
    return joined.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).select(*df.columns, out)


def grouped_rank(
    df: DataFrame, keys: Sequence[str], by: str, out: str = "ord", *, block: int = 1 << 20
) -> DataFrame:
    """0-based rank inside each key group by the integer column ``by`` (unique in a group).

    A hot group is cut into ranges of ``by``; each range is ranked alone and the counts of
    the earlier ranges, one row per (group, range), are added.
    """
    keys = list(keys)
    cut = df.withColumn("_blk", F.floor(F.col(by) / F.lit(block)).cast("bigint"))
    counts = cut.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    carry = counts.select(
        *keys, "_blk",
        F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_blk").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"),
    )
    local = cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_blk").orderBy(by)))
    joined = local.join(carry, [*keys, "_blk"])
    return joined.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).select(*df.columns, out)


def chunked_lists(
    df: DataFrame, keys: Sequence[str], by: str, value: str, *, chunk: int = 4096,
    out: str = "items",
) -> DataFrame:
    """Ordered lists per key, a long one as several rows (key, chunk, list, n)."""
    keys = list(keys)
    ranked = grouped_rank(df, keys, by, "_ord")
    ranked = ranked.withColumn("chunk", F.floor(F.col("_ord") / F.lit(chunk)).cast("bigint"))
    pairs = F.sort_array(F.collect_list(F.struct("_ord", value)))
    return ranked.groupBy(*keys, "chunk").agg(
        F.transform(pairs, lambda p: p[value]).alias(out),
        F.count(F.lit(1)).alias("n"),
    )


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn"
) -> DataFrame:
    """First ``k`` rows per group (1-based ``out``).

    For k up to 1000 Spark itself keeps only k rows per key before the exchange
    (WindowGroupLimit). For larger k a salted first pass does the same by hand, with fewer
    salts the larger k is, so that the second pass meets a bounded number of rows.
    """
    keys = list(keys)
    if k > 1000:
        salts = max(2, min(64, 1_000_000 // k))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt")
    ranked = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)
