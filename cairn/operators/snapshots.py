"""Snapshot algebra: copies, removal, flags, age, and retention by days, weeks, months and years."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.config import ROOT


@dataclass(frozen=True)
class Plan:
    """How many daily, weekly, monthly and yearly bins keep a snapshot each."""

    daily: int = 7
    weekly: int = 4
    monthly: int = 2
    yearly: int = 1

    @staticmethod
    def parse(text: str) -> Plan:
        """'14d,8w,6m,2y': each part a number and the first letter of a unit, in any order; what is not named is 0."""
        found = {u: int(n) for n, u in re.findall(r"(\d+)\s*([dwmy])[a-z]*", text.lower())}
        if not found:
            raise ValueError(f"not a plan: {text!r}")
        return Plan(*(found.get(u, 0) for u in "dwmy"))


def copy(table: DataFrame, source: object, target: object, by: str = "subvol_id") -> DataFrame:
    """The rows of a subvolume under another id: what a snapshot adds to a table. No shuffle."""
    return table.filter(F.col(by) == F.lit(source)).withColumn(by, F.lit(target).cast(table.schema[by].dataType))


def create(subvolumes: DataFrame, inodes: DataFrame, tree: DataFrame, id: int, name: str, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A subvolume with its root folder (mode 0755, two links). One that has the name already is left alone."""
    spark = subvolumes.sparkSession
    new = spark.createDataFrame([(id, name, False, now)], "id long, name string, readonly boolean, created_at timestamp").withColumn("hash", F.md5(F.col("name").cast("binary")))
    new = new.join(subvolumes.select("hash"), "hash", "left_anti")
    ns = int(now.timestamp()) * 10**9
    root = new.select(F.col("id").alias("subvol_id"), F.lit(1).cast("long").alias("id"), F.lit(2).cast("long").alias("nlinks"), F.lit(0o040755).cast("long").alias("mode"), *[F.lit(v).cast("long").alias(c) for c, v in (("uid", 0), ("gid", 0), ("rdev", 0), ("size", 0), ("atime_ns", ns), ("mtime_ns", ns), ("ctime_ns", ns))])
    node = new.select(F.col("id").alias("subvol_id"), F.lit(1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("name_id"), F.lit(1).cast("long").alias("inode_id"))
    return subvolumes.unionByName(new, allowMissingColumns=True), inodes.unionByName(root, allowMissingColumns=True), tree.unionByName(node)


def make(subvolumes: DataFrame, tables: dict[str, DataFrame], source: str, target: str, target_id: int, now: dt.datetime) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A read-only snapshot: the source's rows of every table under a new id, its times of update and its cached figures."""
    own = subvolumes.filter(F.col("name") == source)
    new = own.withColumns({"id": F.lit(target_id).cast("long"), "name": F.lit(target), "hash": F.md5(F.lit(target).cast("binary")), "readonly": F.lit(True), "created_at": F.lit(now).cast("timestamp"), "mounted_at": F.lit(None).cast("timestamp")})
    ids = own.select(F.col("id").alias("subvol_id"))
    out = {k: t.unionByName(t.join(F.broadcast(ids), "subvol_id", "left_semi").withColumn("subvol_id", F.lit(target_id).cast("long"))) for k, t in tables.items()}
    return subvolumes.unionByName(new), out


def remove(subvolumes: DataFrame, tables: dict[str, DataFrame], name: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without a subvolume and its rows; the root stays."""
    if name == ROOT:
        return subvolumes, tables
    gone = F.broadcast(subvolumes.filter(F.col("name") == name).select(F.col("id").alias("subvol_id")))
    return subvolumes.filter(F.col("name") != name), {k: t.join(gone, "subvol_id", "left_anti") for k, t in tables.items()}


def freed(index: DataFrame, gone: DataFrame, sizes: DataFrame) -> DataFrame:
    """What the removal of subvolumes (subvol_id) sets free: hashes that no other has, their bytes as written and as stored."""
    own = F.broadcast(gone.select("subvol_id"))  # a row for each snapshot to remove
    alone = index.join(own, "subvol_id", "left_semi").select("hash_id").distinct().join(index.join(own, "subvol_id", "left_anti").select("hash_id"), "hash_id", "left_anti")
    both = alone.join(sizes.select("hash_id", "writed_size", "compressed_size"), "hash_id", "left")
    return both.agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("writed_size"), F.lit(0)).alias("writed_size"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed_size"))


def readonly(subvolumes: DataFrame, name: str, flag: bool) -> DataFrame:
    return subvolumes.withColumn("readonly", F.when(F.col("name") == name, F.lit(flag)).otherwise(F.col("readonly")))


def without_stats(subvolumes: DataFrame, name: str | None = None) -> DataFrame:
    """Cached figures dropped: of one subvolume, or the root differences of all but the root."""
    hit = F.col("name") == name if name else F.col("name") != ROOT
    columns = ("stats", "stats_at", "root_diff", "root_diff_at") if name else ("root_diff", "root_diff_at")
    return subvolumes.withColumns({c: F.when(~hit, F.col(c)) for c in columns})


def fresh(subvolumes: DataFrame) -> DataFrame:
    """Which cached figures hold: usage if it isn't older than the subvolume, a root difference if it isn't older than either side."""
    root = F.broadcast(subvolumes.filter(F.col("name") == ROOT).select(F.col("updated_at").alias("_root_at")))
    both = subvolumes.join(root, how="left")
    newest = F.greatest(F.col("updated_at"), F.col("_root_at"))
    return both.select("name", (F.col("updated_at") <= F.col("stats_at")).alias("stats_fresh"), (newest <= F.col("root_diff_at")).alias("diff_fresh"))


def older_than(subvolumes: DataFrame, cutoff: str, column: str = "created_at") -> DataFrame:
    """Snapshots made (or last updated) before a time like 2024-03-01T00:00:00."""
    return subvolumes.filter((F.col("name") != ROOT) & (F.col(column) < F.to_timestamp(F.lit(cutoff), "yyyy-MM-dd'T'HH:mm:ss")))


def created_on(subvolumes: DataFrame, day: str, count_readonly: bool = False) -> DataFrame:
    """How many subvolumes a day made; count_readonly: only read-only ones."""
    hit = (F.col("name") != ROOT) & (F.to_date("created_at") == F.lit(day).cast("date"))
    return subvolumes.filter(hit & F.col("readonly") if count_readonly else hit).agg(F.count(F.lit(1)).alias("cnt"))


def bins(at: Column, now: Column, plan: Plan) -> Column:
    """array<struct<kind, bin>> of the bins a time falls in: days and weeks count back from today (weeks are seven days that end today), months and years by calendar."""
    day = F.datediff(now, at)
    month = (F.year(now) - F.year(at)) * 12 + F.month(now) - F.month(at)
    year = F.year(now) - F.year(at)
    each = (("day", day, plan.daily), ("week", F.floor(day / 7).cast("int"), plan.weekly), ("month", month, plan.monthly), ("year", year, plan.yearly))
    inside = [F.when((n >= 0) & (n < most), F.struct(F.lit(kind).alias("kind"), n.alias("bin"))) for kind, n, most in each]
    return F.array_compact(F.array(*inside))


def retained(dates: DataFrame, at: str, now: str, plan: Plan) -> DataFrame:
    """The times that a plan keeps: of a day's bin the latest, of the others' the earliest. Two aggregates; the bins are few."""
    when = F.to_timestamp_ntz(F.lit(now)) if dict(dates.dtypes)[at] == "timestamp_ntz" else F.to_timestamp(F.lit(now))
    placed = dates.select(at, F.explode(bins(F.col(at), when, plan)).alias("b"))
    kept = placed.groupBy("b.kind", "b.bin").agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    return kept.select(F.when(F.col("kind") == "day", F.col("_last")).otherwise(F.col("_first")).alias(at)).distinct()


def removed(dates: DataFrame, at: str, now: str, plan: Plan) -> DataFrame:
    """The other times."""
    return dates.select(at).distinct().join(retained(dates, at, now, plan), at, "left_anti")


def removed_by_plan(subvolumes: DataFrame, now: str, plan: Plan, column: str = "created_at") -> DataFrame:
    """Snapshots that a plan removes: all whose time is a removed one."""
    own = subvolumes.filter(F.col("name") != ROOT).withColumn(column, F.date_trunc("second", column))
    return own.join(removed(own, column, now, plan), column, "left_semi")
