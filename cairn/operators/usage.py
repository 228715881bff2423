"""What a store holds: usage for each subvolume, reports, codec shares, reference counts, differences from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.config import ROOT
from cairn.functions.text import page_size, percent


def total(column: str | Column, name: str) -> Column:
    """A sum that is 0 where there is nothing."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("long").alias(name)


def usage(index: DataFrame, inodes: DataFrame, sizes: DataFrame, by: str = "subvol", tree: DataFrame | None = None) -> DataFrame:
    """Usage for every subvolume at once.

    index: by, inode_id, hash_id, real_size; inodes: by, id, size; sizes: hash_id, writed_size, compressed_size; tree: by, inode_id, to leave out
    inodes that no name leads to. apparent counts each inode with a block once; data and compressed count every index row, unique ones each hash
    once in its subvolume; dedup = data - unique, sparse = apparent - data.

    Index rows are counted by (subvolume, hash) first, so that the join with sizes sees each hash once and a hot hash is one row.
    """
    if tree is not None:
        index = index.join(tree.select(by, "inode_id").distinct(), [by, "inode_id"], "left_semi")
    refs = index.groupBy(by, "hash_id").agg(F.count(F.lit(1)).alias("n"))
    data = refs.join(sizes, "hash_id").groupBy(by).agg(
        total(F.col("writed_size") * F.col("n"), "data_size"),
        total("writed_size", "unique_size"),
        total(F.col("compressed_size") * F.col("n"), "compressed_size"),
        total("compressed_size", "compressed_unique_size"),
        total("n", "blocks"),
        F.count(F.lit(1)).alias("unique_blocks"),
    )
    owning = index.select(by, F.col("inode_id").alias("id")).distinct()
    apparent = inodes.select(by, "id", "size").join(owning, [by, "id"], "left_semi").groupBy(by).agg(total("size", "apparent_size"))
    out = data.join(apparent, by, "left").withColumn("apparent_size", F.coalesce("apparent_size", F.lit(0).cast("long")))
    return out.withColumn("dedup_size", F.col("data_size") - F.col("unique_size")).withColumn("sparse_size", F.col("apparent_size") - F.col("data_size"))


def usage_report(found: DataFrame, by: str = "subvol") -> DataFrame:
    """Shares in percent over a usage table."""
    return found.select(
        by, "apparent_size", "data_size", "unique_size", "compressed_size", "compressed_unique_size",
        F.round(percent(F.col("compressed_size"), F.col("apparent_size")), 4).alias("compressed_pct"),
        F.round(percent(F.col("compressed_unique_size"), F.col("unique_size")), 4).alias("compressed_unique_pct"),
        F.round(percent(F.col("dedup_size"), F.col("data_size")), 4).alias("dedup_pct"),
        F.round(percent(F.col("sparse_size"), F.col("apparent_size")), 4).alias("sparse_pct"),
    )


def codec_rows(index: DataFrame, types: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Index rows by codec, with their share. A hash's rows are counted before the join."""
    by = by or []
    refs = index.groupBy(*by, "hash_id").agg(F.count(F.lit(1)).alias("n"))
    out = refs.join(types, "hash_id").groupBy(*by, "codec").agg(total("n", "cnt"))
    return _shares(out, by)


def codec_unique(index: DataFrame, types: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct hashes by codec, with their share."""
    by = by or []
    out = index.select(*by, "hash_id").distinct().join(types, "hash_id").groupBy(*by, "codec").agg(F.count(F.lit(1)).alias("cnt"))
    return _shares(out, by)


def _shares(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.withColumn("pct", F.round(F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy(*by)), 4))  # a row for each codec


def apparent_checked(inodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Sizes of linked inodes that a name leads to."""
    return inodes.filter("nlinks > 0").join(tree.select(F.col("inode_id").alias("id")), "id", "left_semi").agg(total("size", "apparent_size"))


def apparent_fast(inodes: DataFrame) -> DataFrame:
    """Sizes of all linked inodes."""
    return inodes.filter("nlinks > 0").agg(total("size", "apparent_size"))


def root_diff(index: DataFrame, root: object, by: str = "subvol") -> DataFrame:
    """For every other subvolume its index rows with hashes that the root has not: how many, and their real size. The root differs by nothing."""
    own = index.filter(F.col(by) == F.lit(root)).select("hash_id").distinct()
    rest = index.filter(F.col(by) != F.lit(root)).join(own, "hash_id", "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("diff_blocks"), total("real_size", "diff_real_size"))
    every = index.select(by).distinct()
    zero = F.lit(0).cast("long")
    return every.join(rest, by, "left").select(by, F.coalesce("diff_blocks", zero).alias("diff_blocks"), F.coalesce("diff_real_size", zero).alias("diff_real_size"))


def listing(subvolumes: DataFrame, apparent: DataFrame, diff: DataFrame | None = None, by: str = "name") -> DataFrame:
    """Subvolumes by time of creation, with sizes and what stands where a time is missing. apparent: by, apparent_size; diff: by, diff_blocks, diff_real_size."""
    out = subvolumes.join(apparent, by, "left")
    if diff is not None:
        out = out.join(diff, by, "left")
    none = F.lit("---")
    say = lambda c, text: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(text))
    columns = [by, "readonly", F.coalesce("apparent_size", F.lit(0).cast("long")).alias("apparent_size")]
    if diff is not None:
        columns += [F.coalesce(F.col("diff_real_size").cast("string"), none).alias("diff_real_size"), F.coalesce(F.col("diff_blocks").cast("string"), none).alias("diff_blocks")]
    columns += [say("created_at", "---").alias("created"), say("mounted_at", "not mounted").alias("mounted"), say("updated_at", "not updated").alias("updated")]
    return out.orderBy("created_at", by).select(*columns)


def disk_report(index: DataFrame, inodes: DataFrame, sizes: DataFrame, disk_bytes: int) -> DataFrame:
    """One row over the whole store: sizes, and shares of dedup, holes, compression, and what the store's own files add."""
    refs = index.groupBy("hash_id").agg(F.count(F.lit(1)).alias("n"))
    data = refs.join(sizes, "hash_id").agg(total(F.col("writed_size") * F.col("n"), "data_size"), total("writed_size", "unique_size"), total("compressed_size", "compressed_unique_size"))
    both = data.crossJoin(F.broadcast(apparent_fast(inodes)))  # one row each
    d = F.lit(int(disk_bytes)).cast("long")
    return both.select(
        "apparent_size", "data_size", "unique_size", "compressed_unique_size", d.alias("disk_size"),
        F.round(percent(F.col("data_size") - F.col("unique_size"), F.col("data_size")), 4).alias("dedup_pct"),
        F.round(percent(F.col("apparent_size") - F.col("data_size"), F.col("apparent_size")), 4).alias("sparse_pct"),
        F.round(percent(F.col("unique_size") - F.col("compressed_unique_size"), F.col("unique_size")), 4).alias("saved_pct"),
        F.round(percent(d - F.col("compressed_unique_size"), F.col("compressed_unique_size")), 4).alias("overhead_pct"),
    )


def refcounts(index: DataFrame) -> DataFrame:
    """Exact references of every hash."""
    return index.groupBy("hash_id").agg(F.count(F.lit(1)).alias("refs"))


def write_refcounts(log: DataFrame, index: DataFrame) -> DataFrame:
    """References by writes, an upper bound, beside the exact ones, which may be 0."""
    writes = log.groupBy("hash_id").agg(F.count(F.lit(1)).alias("write_refs"))
    return writes.join(refcounts(index), "hash_id", "left").select("hash_id", "write_refs", F.coalesce("refs", F.lit(0).cast("long")).alias("live_refs"))


def typical_sizes(sizes: DataFrame) -> DataFrame:
    """Median (exact; of an even number the mean of the two in the middle) and mean of compressed sizes, 0 without blocks, and the page size that follows."""
    out = sizes.agg(F.coalesce(F.expr("percentile(compressed_size, 0.5)"), F.lit(0.0)).alias("median_size"), F.round(F.coalesce(F.avg("compressed_size"), F.lit(0.0)), 4).alias("mean_size"))
    return out.withColumn("page_size", page_size(F.col("median_size")))


def statfs(inodes: DataFrame, block_size: int, free_bytes: int) -> DataFrame:
    """What a file system tells of itself."""
    used = inodes.agg(total(F.when(F.col("nlinks") > 0, F.col("size")), "used"), F.count(F.lit(1)).alias("files"))
    return used.select(
        F.ceil(F.col("used") / block_size).cast("long").alias("blocks"), F.ceil(F.lit(free_bytes) / F.lit(block_size)).cast("long").alias("bavail"),
        "files", F.lit(block_size).cast("long").alias("bsize"), F.lit(65000).cast("long").alias("namemax"),
    )


def throughput(ops: DataFrame) -> DataFrame:
    """ops (op, bytes, written, compressed, seconds) -> counts, time, rate and saved share by operation, those under 0.1 % of the time left out."""
    out = ops.groupBy("op").agg(F.count(F.lit(1)).alias("cnt"), F.sum("seconds").alias("seconds"), total("bytes", "bytes"), total("written", "written"), total("compressed", "compressed"))
    out = out.withColumn("time_pct", F.col("seconds") * 100.0 / F.sum("seconds").over(Window.partitionBy()))  # a row for each operation
    rate = F.col("bytes") / F.greatest(F.col("seconds"), F.lit(1.0))
    saved = percent(F.col("written") - F.col("compressed"), F.col("written"))
    return out.filter("time_pct >= 0.1").select("op", "cnt", "seconds", "bytes", F.round(rate, 4).alias("bytes_per_second"), F.round(saved, 4).alias("saved_pct"), F.round("time_pct", 4).alias("time_pct")).orderBy(F.desc("time_pct"), "op")


def not_root(subvolumes: DataFrame, name: str = "name") -> DataFrame:
    return subvolumes.filter(F.col(name) != ROOT)
