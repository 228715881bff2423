"""Write-back caches as micro-batches: dedup ingest, last write wins, idle sessions, ticks, debounce, eviction.

Each streaming job has a batch twin of the same result, by which it is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.blocks import cut, first_occurrence


def replay(spark: SparkSession, path: str, schema: object, files: int = 1) -> DataFrame:
    """Parquet files as a stream, so many to a batch: all of a folder, or the one file that path names."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def dedup_stream(blocks: DataFrame, ts: str = "ts", lateness: str = "10 seconds") -> DataFrame:
    """Blocks whose digest was not seen within the lateness; state is bounded by the watermark."""
    return blocks.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["digest"])


def ingest(stream: DataFrame, folder: str, checkpoint: str, block_size: int, order: list[str], interval: str | None = None) -> StreamingQuery:
    """Cut, trim, hash and store what arrives: index rows are appended, new blocks too.

    A batch's output is written under its number, so that a batch that is run again after a failure replaces its own rows; blocks are
    new if no earlier batch has their digest. order: columns that put the batch's rows in order.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = cut(batch, block_size)
        index.drop("stored").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/index/batch={number}")
        fresh = first_occurrence(index, [*order, "block_number"])
        jvm = spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(f"{folder}/blocks")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(f"{folder}/blocks")
            fresh = fresh.join(old.filter(F.col("batch") != number).select("digest"), "digest", "left_anti")
        fresh.select("digest", "stored", "writed_size").write.mode("overwrite").parquet(f"{folder}/blocks/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def last_state(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key so far (complete or update mode)."""
    rest = [c for c in stream.columns if c not in (key, order)]
    return stream.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("l")).select(key, "l.*")


def idle_sessions(events: DataFrame, key: str, ts: str = "ts", idle: str = "10 seconds") -> DataFrame:
    """How a cached item lives while it is touched and goes after an idle time: one row for each stretch."""
    return events.groupBy(key, F.session_window(ts, idle).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("expires"), "n")


def flush_ticks(events: DataFrame, ts: str = "ts", every: str = "5 seconds") -> DataFrame:
    """What each flush interval gathers."""
    return events.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("tick"), "n")


def debounced(events: DataFrame, key: str, ts: str = "ts", every: str = "1 second") -> DataFrame:
    """At most one update for a key in each interval: its last time."""
    return events.groupBy(key, F.window(ts, every).alias("w")).agg(F.max(ts).alias("updated_at")).select(key, "updated_at")


def evicted(items: DataFrame, size: str, age: list[Column], budget: int, by: str | None = None, high: float = 1.02, low: float = 0.98) -> DataFrame:
    """Items to evict, oldest first, of caches that are beyond `high` of their budget, until they are at `low` or under.

    by: the cache an item is in. Running sums need order within one cache; a cache fits its machine's memory.
    """
    part = [by] if by else []
    w = Window.partitionBy(*part)
    rows = items.withColumn("_all", F.sum(size).over(w)).withColumn("_upto", F.sum(size).over(w.orderBy(*age).rowsBetween(Window.unboundedPreceding, 0)))
    gone = (F.col("_all") > budget * high) & (F.col("_all") - (F.col("_upto") - F.col(size)) > budget * low)
    return rows.filter(gone).drop("_all", "_upto")
