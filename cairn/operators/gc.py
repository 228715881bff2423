"""Garbage: what nothing refers to, as anti-joins in order of dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.blocks import truncated


def dead(rows: DataFrame, live: DataFrame, key: str, live_key: str | None = None) -> DataFrame:
    """Rows whose key is in no live row."""
    return rows.join(live.select(F.col(live_key or key).alias(key)), key, "left_anti")


def alive(rows: DataFrame, live: DataFrame, key: str, live_key: str | None = None) -> DataFrame:
    return rows.join(live.select(F.col(live_key or key).alias(key)), key, "left_semi")


def dead_names(names: DataFrame, tree: DataFrame) -> DataFrame:
    """Names that no node of any subvolume has."""
    return dead(names, tree, "id", "name_id")


def dead_inodes(inodes: DataFrame, tree: DataFrame) -> DataFrame:
    return dead(inodes, tree, "id", "inode_id")


def dead_of_inodes(rows: DataFrame, inodes: DataFrame) -> DataFrame:
    """Attributes, link targets or index rows without their inode."""
    return dead(rows, inodes, "inode_id", "id")


def dead_hashes(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """Hashes that no index row of any subvolume has."""
    return dead(hashes, index, "hash_id")


def unused_by_count(deltas: DataFrame) -> DataFrame:
    """Hashes whose references sum to nothing."""
    return deltas.groupBy("hash_id").agg(F.sum("delta").alias("cnt")).filter("cnt <= 0").select("hash_id")


def dead_owners(owners: DataFrame, index: DataFrame) -> DataFrame:
    return dead(owners, index, "hash_id")


def collect(tables: dict[str, DataFrame], block_size: int | None = None) -> dict[str, DataFrame]:
    """What stays of every table: names, inodes, attributes, targets, index (cut to file sizes), owners, blocks and their satellites."""
    t = dict(tables)
    t["name"] = alive(t["name"], t["tree"], "id", "name_id")
    t["inode"] = alive(t["inode"], t["tree"], "id", "inode_id")
    for k in ("xattr", "link", "inode_hash_block"):
        if k in t:
            t[k] = alive(t[k], t["inode"], "inode_id", "id")
    index = t["inode_hash_block"]
    if block_size:
        index = t["inode_hash_block"] = truncated(index, t["inode"].select(F.col("id").alias("inode_id"), "size"), "inode_id", "block_number", block_size)
    live = index.select("hash_id").distinct()
    for k in ("hash_owner", "block", "hash_sizes", "hash_compression_type"):
        if k in t:
            t[k] = alive(t[k], live, "hash_id")
    if "hash" in t:
        t["hash"] = alive(t["hash"], live, "id", "hash_id")
    return t


def summary(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """One row for each table: rows, and dead ones. parts: name -> (rows, dead rows)."""
    out = None
    for name, (rows, gone) in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(gone.agg(F.count(F.lit(1)).alias("dead"))))  # one row each
        one = one.select(F.lit(name).alias("name"), "total", "dead")
        out = one if out is None else out.unionByName(one)
    return out
