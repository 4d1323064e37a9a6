"""Structured Streaming jobs over arriving mini-batches and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from nodeloom.plans.store import fresh_path


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files with a declared schema."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def stream_gather(index_stream: DataFrame, features: DataFrame, tasks: int | None = None) -> DataFrame:
    """Feature rows for arriving index rows: a stream-static join, nothing kept in state.

    A left join, so an index row without features shows up as NULL and can be counted.
    ``tasks`` deals the narrow rows out before the wide ones are fetched, for sources that
    deliver few large files.
    """
    if tasks:
        index_stream = index_stream.repartition(tasks)
    return index_stream.join(features.select("node_id", "feat"), "node_id", "left")


def stream_frequency(accesses: DataFrame, key: str = "node_id") -> DataFrame:
    """Running access count per node (update mode)."""
    return accesses.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stream_batch_frequency(accesses: DataFrame, open_batches: int | None = None) -> DataFrame:
    """Running number of batches per node: a node counts once per batch (update mode).

    With ``open_batches`` the batch number (0 or more) is the event time: once a batch is so many behind the
    newest one of earlier triggers, its (batch, node) pairs leave the state and rows of it that still
    come are not counted (Spark reports them as dropped by the watermark). Without it every pair is kept
    for ever; :func:`run_batch_frequency` is exact for any order and keeps none.
    """
    if open_batches is None:
        once = accesses.dropDuplicates(["batch_id", "node_id"])
    else:
        timed = accesses.withColumn("_at", F.timestamp_seconds(F.col("batch_id") + 1)).withWatermark("_at", f"{open_batches} seconds")
        once = timed.dropDuplicatesWithinWatermark(["batch_id", "node_id"])
    return once.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_batches"))


def run_batch_frequency(accesses: DataFrame, name: str = "frequency") -> DataFrame:
    """(node_id, n_batches) over all that has arrived, in any order.

    Each trigger writes the pairs of batch and node that it saw, and reading counts them once: nothing
    is held in state, and no trigger reads what another wrote.
    """
    spark = accesses.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    pairs = accesses.select("batch_id", "node_id")

    def sink(df: DataFrame, epoch: int) -> None:
        df.distinct().write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated trigger replaces its own

    query = pairs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    seen = spark.read.schema(StructType([*pairs.schema.fields, StructField("epoch", LongType())])).parquet(out)
    return seen.select("batch_id", "node_id").distinct().groupBy("node_id").agg(F.count(F.lit(1)).alias("n_batches"))


def stream_windowed_frequency(accesses: DataFrame, width: str, late: str, key: str = "node_id") -> DataFrame:
    """Access count per node and tumbling event-time window; state is dropped once ``late`` passed."""
    return (accesses.withWatermark("ts", late)
            .groupBy(F.window("ts", width).alias("w"), F.col(key))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), key, "n"))


def run_windowed_frequency(accesses: DataFrame, width: str, late: str, key: str = "node_id", name: str = "windows") -> DataFrame:
    """(window_start, key, n, n_late): counts per tumbling event-time window over all that has arrived.

    Each trigger writes its own partial counts, and reading adds them up: nothing is held in
    state, so no row is ever too late to count. ``n_late`` tells how many of a window's rows came
    when earlier triggers had already seen times more than ``late`` after the window's end. The latest
    time so far is written as one row per trigger, which is all that the next trigger reads.
    """
    spark = accesses.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    parts = StructType([
        StructField("window_start", TimestampType()), accesses.schema[key], StructField("n", LongType()), StructField("n_late", LongType()),
        StructField("epoch", LongType())])
    marks, mark = fresh_path(spark, f"{name}-mark"), StructType([StructField("last", TimestampType())])

    def sink(df: DataFrame, epoch: int) -> None:
        seen = spark.read.schema(mark).parquet(f"{marks}/{epoch - 1}").first()["last"] if epoch else None
        closed = F.lit(seen) - F.expr(f"INTERVAL {late}") if seen else F.lit(None).cast("timestamp")
        told = df.withColumn("_w", F.window("ts", width)).withColumn("_late", F.coalesce(F.col("_w.end") <= closed, F.lit(False)))
        newest = Observation()
        part = told.observe(newest, F.max("ts").alias("last")).groupBy(F.col("_w.start").alias("window_start"), key).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("_late").alias("n_late"))
        part.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated trigger replaces its own
        last = max((t for t in (seen, newest.get["last"]) if t is not None), default=None)
        spark.createDataFrame([(last,)], mark).coalesce(1).write.mode("overwrite").parquet(f"{marks}/{epoch}")

    query = accesses.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(parts).parquet(out).groupBy("window_start", key).agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over everything that has arrived and return what it wrote.

    Output and checkpoint live in the shared folder. In update mode every trigger writes its
    changed rows with the trigger number; use :func:`latest` for the final state.
    """
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query: StreamingQuery = writer.outputMode("append").format("parquet").option("path", out).start()
        schema = stream.schema
    else:
        def sink(df: DataFrame, epoch: int) -> None:
            # Overwriting the trigger's own folder makes a repeated trigger harmless.
            df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        query = writer.outputMode(mode).foreachBatch(sink).start()
        schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def latest(updates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last written value per key."""
    last = F.max(F.struct("epoch", *values)).alias("_l")
    return updates.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_l.{v}").alias(v) for v in values])
