"""Where bytes come from: the driver tables, files on a file system, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, data of every file under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("content").alias("data"))


def write_block_files(blocks: DataFrame, path: str, digest: str = "digest", data: str = "data") -> None:
    """Blocks as rows keyed by digest, in folders by its first digits: what a fan-out of files serves, readable as one table."""
    blocks.withColumn("fan", F.substring(digest, 1, 2)).repartition("fan").write.partitionBy("fan").mode("overwrite").parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, in ranges of a key where bounds are given. The driver must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()
