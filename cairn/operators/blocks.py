"""From byte streams to a deduplicated block table and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import binary


def cut(files: DataFrame, block_size: int, hash_function: str = "md5", data: str = "data", padded: bool = False) -> DataFrame:
    """One row for each block of each file: block_number, real_size, stored (trailing NULs trimmed), writed_size, digest.

    padded: the last block is filled with NULs to the block size first, as a reader of whole blocks hands it over; trimming takes
    them away again, so that the digest is the same. No shuffle.
    """
    rest = [c for c in files.columns if c != data]
    out = files.select(*rest, F.explode(binary.blocks(F.col(data), block_size)).alias("_b")).select(*rest, "_b.block_number", F.col("_b.data").alias("data"))
    if padded:
        out = out.withColumn("data", binary.pad_zeros(F.col("data"), F.lit(block_size)))
    out = out.withColumn("real_size", F.octet_length("data").cast("long")).withColumn("stored", binary.trim_zeros(F.col("data"))).drop("data")
    return out.withColumn("writed_size", F.octet_length("stored").cast("long")).withColumn("digest", binary.digest(F.col("stored"), hash_function))


def first_occurrence(index: DataFrame, order: list[str]) -> DataFrame:
    """Each digest's first place in a total order: the row that stores the block. A min-aggregate, combined before the shuffle."""
    keep = [c for c in index.columns if c not in ("digest", *order)]
    first = index.groupBy("digest").agg(F.min(F.struct(*order, *keep)).alias("_f"), F.count(F.lit(1)).alias("refs"))
    return first.select("digest", "_f.*", "refs")


def new_blocks(index: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """First occurrences whose digest no stored block has yet: what a dedup write adds."""
    return first_occurrence(index, order).join(existing.select("digest"), "digest", "left_anti")


def collisions(index: DataFrame, data: str = "stored") -> DataFrame:
    """Digests under which different bytes were seen."""
    bad = index.groupBy("digest").agg(F.count_distinct(F.sha2(F.col(data), 256)).alias("contents"))
    return bad.filter("contents > 1")


def last_write(log: DataFrame, key: list[str], order: list[str], combine: bool = False) -> DataFrame:
    """The last row of each key in a total order.

    Most keys of a write log are written once or twice, so rows are dealt by key and sorted once; combine: keys are written so often that
    taking each task's last row first (a struct max, which sorts before the shuffle too) moves much less.
    """
    if combine:
        rest = [c for c in log.columns if c not in (*key, *order)]
        return log.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_l")).select(*key, "_l.*")
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.repartition(*key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_range(index: DataFrame, inode: str, number: str, data: str, block_size: int, offset: Column, size: Column, file_size: Column) -> DataFrame:
    """Bytes [offset, offset + size) of each file, cut off at its size, from rows (inode, number, data as a reader sees it).

    Only blocks that the range touches are gathered; a missing block reads as NULs.
    """
    end = F.least(offset + size, file_size)
    hit = index.filter((F.col(number) >= F.floor(offset / block_size)) & (F.col(number) * block_size < end))
    hit = hit.withColumn("_end", end).withColumn("_offset", offset)
    parts = F.sort_array(F.collect_list(F.struct(F.col(number).cast("long").alias("n"), F.hex(F.col(data)).alias("d"))))
    got = hit.groupBy(inode).agg(parts.alias("_p"), F.first("_end").alias("_end"), F.first("_offset").alias("_offset"))
    lo, hi = F.floor(F.col("_offset") / block_size), F.floor((F.col("_end") - 1) / block_size)
    # each block is filled up to where the next one that exists begins; the first also from where the range begins
    following = lambda i: F.coalesce(F.get(F.col("_p"), i + 1)["n"], hi + 1)
    filled = F.transform("_p", lambda p, i: F.rpad(p["d"], ((following(i) - p["n"]) * (2 * block_size)).cast("int"), "00"))
    before = F.repeat(F.lit("00"), ((F.get(F.col("_p"), F.lit(0))["n"] - lo) * block_size).cast("int"))
    got = got.withColumn("_w", F.concat(before, F.array_join(filled, "")))
    skip = F.col("_offset") - lo * block_size
    return got.select(inode, F.unhex(F.substring("_w", (skip * 2 + 1).cast("int"), ((F.col("_end") - F.col("_offset")) * 2).cast("int"))).alias("data"))


def truncated(index: DataFrame, bounds: DataFrame, inode: str, number: str, block_size: int, strict: bool = False) -> DataFrame:
    """Index rows that stay when files are cut to bounds (inode, size): numbers up to floor(size / block size).

    A file whose size is a multiple of the block size so keeps one block too many, as stores of this kind do; strict drops it.
    Files without a bound stay whole.
    """
    bounds = bounds.select(F.col(inode).alias("_i"), F.col("size").alias("_size"))
    rows = index.join(bounds, index[inode] == F.col("_i"), "left")
    last = F.ceil(F.col("_size") / block_size) - 1 if strict else F.floor(F.col("_size") / block_size)
    return rows.filter(F.col("_size").isNull() | (F.col(number) <= last)).drop("_i", "_size")


def repaired_sizes(index: DataFrame, inodes: DataFrame, block_size: int) -> DataFrame:
    """Old index rows hold real_size 0: a whole block, or what the file's size leaves for its last one."""
    sizes = inodes.select(F.col("id").alias("inode_id"), F.col("size").alias("_size"))
    left = F.greatest(F.least(F.col("_size") - F.col("block_number") * block_size, F.lit(block_size)), F.lit(0))
    return index.join(sizes, "inode_id", "left").withColumn("real_size", F.when(F.col("real_size") > 0, F.col("real_size")).otherwise(F.coalesce(left, F.lit(0))).cast("long")).drop("_size")


def write_spans(writes: DataFrame, block_size: int) -> DataFrame:
    """Writes (inode_id, offset, data) -> one row for each block touched: block_number, start in the block, and its bytes."""
    n = F.octet_length("data")
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("offset") + n - 1) / block_size)
    out = writes.filter(n > 0).withColumn("block_number", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("offset"), F.col("block_number") * block_size)
    end = F.least(F.col("offset") + F.octet_length("data"), (F.col("block_number") + 1) * block_size)
    part = F.substring("data", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    return out.withColumn("start", (begin - F.col("block_number") * block_size).cast("int")).withColumn("data", part)


def merged_writes(stored: DataFrame, writes: DataFrame, block_size: int) -> DataFrame:
    """Writes (inode_id, seq, offset, data) put into stored blocks (inode_id, block_number, data): the blocks that change, as they are then.

    Of bytes written several times the last write's stay; a block's bytes that nothing has written are NULs. A block's writes are gathered, no file's.
    """
    spans = write_spans(writes, block_size).groupBy("inode_id", "block_number").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "data"))).alias("_spans"))
    old = spans.join(stored.select("inode_id", "block_number", F.col("data").alias("_old")), ["inode_id", "block_number"], "left")

    def put(block: Column, span: Column) -> Column:
        n = F.octet_length(span["data"])
        whole = binary.pad_zeros(block, span["start"])
        return F.concat(F.substring(whole, F.lit(1), span["start"]), span["data"], F.substring(whole, span["start"] + n + 1, F.lit(block_size)))

    data = F.aggregate("_spans", F.coalesce("_old", F.lit(b"")), put)
    return old.select("inode_id", "block_number", data.alias("data"))


def rewritten(index: DataFrame, changed: DataFrame, hash_function: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Changed blocks (inode_id, block_number, data) -> the index (inode_id, block_number, digest, real_size) with their new rows, and the blocks to store, once each."""
    own = changed.select("inode_id", "block_number", F.octet_length("data").cast("long").alias("real_size"), binary.trim_zeros(F.col("data")).alias("stored")).withColumn("digest", binary.digest(F.col("stored"), hash_function))
    kept = index.join(own.select("inode_id", "block_number"), ["inode_id", "block_number"], "left_anti").select("inode_id", "block_number", "digest", "real_size")
    return kept.unionByName(own.select("inode_id", "block_number", "digest", "real_size")), own.groupBy("digest").agg(F.first("stored").alias("stored"))
