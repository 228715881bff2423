"""Command line over a store on disk: make it, look at it, clean it."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.config import BLOCK_DEFAULT, ROOT, EngineConfig
from cairn.operators import codecs, gc, integrity, snapshots, usage
from cairn.sources.catalog import PER_SUBVOLUME, Catalog
from cairn.sources.shared import written

COMMANDS = ("create", "list-subvol", "create-subvol", "remove-subvol", "create-snapshot", "remove-snapshot", "freed-by-removal", "defragment-clustered", "set-readonly", "unset-readonly", "remove-older-than", "count-older-than", "remove-by-plan", "count-by-plan", "created-today", "subvol-stats", "subvol-diff", "print-stats", "defragment", "verify", "rehash", "recompress", "vacuum")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("argument", nargs="*", help="a name, a time, a plan like 14d,8w,6m,2y")
    p.add_argument("--data", required=True, help="the store's folder")
    p.add_argument("--data-clustered", help="the folder of what nodes share")
    p.add_argument("--block-size", type=int, default=BLOCK_DEFAULT)
    p.add_argument("--block-partitions", type=int, default=1)
    p.add_argument("--hash", default="md5")
    p.add_argument("--compress", action="append", help="codec or codec:level; all, all_fast, all_best")
    p.add_argument("--force-compress", action="store_true")
    p.add_argument("--minimal-compress-size", type=int, default=512)
    p.add_argument("--minimal-compress-ratio", type=float, default=0.01)
    p.add_argument("--by-last-update", action="store_true", help="age by updated_at, not created_at")
    p.add_argument("--now", help="the time that plans and days count from")
    p.add_argument("--parsable", action="store_true")
    return p


def config_of(a: argparse.Namespace) -> EngineConfig:
    return EngineConfig(a.block_size, a.hash, tuple(a.compress or ("none",)), a.minimal_compress_size, a.minimal_compress_ratio, a.force_compress, a.block_partitions, a.data, a.data_clustered)


def run(spark: SparkSession, argv: list[str]) -> object:
    """Carry out a command; what it gives is a DataFrame, a number or nothing."""
    a = parser().parse_args(argv)
    c = Catalog(spark, config_of(a)).create()
    t = lambda name: c.table(name).rows
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now().replace(microsecond=0)
    column = "updated_at" if a.by_last_update else "created_at"
    subs, names = t("subvolume"), a.argument

    def drop(rows) -> int:
        gone = [r.id for r in rows.filter(F.col("name") != ROOT).select("id").collect()]  # a row for each snapshot to remove
        c.write("subvolume", subs.filter(~F.col("id").isin(*gone)) if gone else subs)
        for i in gone:  # nobody looks for them any more
            c.drop_subvolume(i)
        return len(gone)

    def next_id() -> int:
        return (subs.agg(F.max("id")).first()[0] or 0) + 1

    match a.command:
        case "create":
            return None
        case "list-subvol":
            apparent = t("inode").filter("nlinks > 0").groupBy("subvol_id").agg(usage.total("size", "apparent_size")).join(subs.select(F.col("id").alias("subvol_id"), "name"), "subvol_id").drop("subvol_id")
            return usage.listing(subs, apparent)
        case "create-subvol":
            c.write_all(dict(zip(("subvolume", "inode", "tree"), snapshots.create(subs, t("inode"), t("tree"), next_id(), names[0], now), strict=True)))
        case "create-snapshot":
            source, new = subs.filter(F.col("name") == names[0]).first(), next_id()
            if source is None:
                raise SystemExit(f"no subvolume {names[0]!r}")
            c.drop_subvolume(new)  # what a run that was lost may have left
            c.write_all({n: snapshots.copy(t(n), source.id, new) for n in PER_SUBVOLUME}, "append")
            c.write("subvolume", snapshots.make(subs, {}, names[0], names[1], new, now)[0])
        case "remove-subvol" | "remove-snapshot":
            return drop(subs.filter(F.col("name") == names[0]))
        case "freed-by-removal":
            return snapshots.freed(t("inode_hash_block"), subs.filter((F.col("name") != ROOT) & F.col("name").isin(*names)).select(F.col("id").alias("subvol_id")), t("hash_sizes"))
        case "defragment-clustered":
            unused = gc.unused_by_count(t("hash_count"))
            keys = {"hash": "id", "block": "hash_id", "hash_sizes": "hash_id", "hash_compression_type": "hash_id", "hash_owner": "hash_id", "hash_count": "hash_id"}
            counts = {"hashes": unused.count()}
            c.write_all({n: t(n).join(unused.withColumnRenamed("hash_id", k), k, "left_anti") for n, k in keys.items()})
            return counts
        case "set-readonly" | "unset-readonly":
            c.write("subvolume", snapshots.readonly(subs, names[0], a.command == "set-readonly"))
        case "remove-older-than":
            return drop(snapshots.older_than(subs, names[0], column))
        case "count-older-than":
            return snapshots.older_than(subs, names[0], column).count()
        case "remove-by-plan":
            return drop(snapshots.removed_by_plan(subs, now.isoformat(" "), snapshots.Plan.parse(names[0]), column))
        case "count-by-plan":
            return snapshots.removed_by_plan(subs, now.isoformat(" "), snapshots.Plan.parse(names[0]), column).count()
        case "created-today":
            return snapshots.created_on(subs, now.date().isoformat()).first()[0]
        case "subvol-stats":
            found = usage.usage(t("inode_hash_block"), t("inode"), t("hash_sizes"), by="subvol_id")
            return usage.usage_report(found, "subvol_id")
        case "subvol-diff":
            return usage.root_diff(t("inode_hash_block"), 1, by="subvol_id")
        case "print-stats":
            return usage.disk_report(t("inode_hash_block"), t("inode"), t("hash_sizes"), sum(c.size(n) for n in ("block", "hash", "hash_sizes", "inode_hash_block", "inode", "tree", "name")))
        case "defragment":
            before = {n: t(n) for n in ("tree", "name", "inode", "xattr", "link", "inode_hash_block", "hash_owner", "block", "hash_sizes", "hash_compression_type", "hash")}
            after = gc.collect(before)
            counts = {n: before[n].count() - after[n].count() for n in before}
            c.write_all(after | {"subvolume": snapshots.without_stats(subs)})
            return counts
        case "verify":
            return integrity.verified_counts(integrity.verify(_blocks(t), c.config.hash_function))
        case "rehash":
            new = integrity.rehash(_blocks(t), a.hash).select(F.col("hash_id").alias("id"), F.col("digest").alias("value"))
            c.write_all({"hash": new, "option": c.table("option").update("hash_function", value=a.hash)})
        case "recompress":
            kinds = {n: i for i, n in enumerate(sorted(codecs.CODECS), 1)}
            made = integrity.recompress(_blocks(t), c.config)
            made = written(made, "recompress")  # once, so that sizes, codecs and payloads are of one run
            number = F.element_at(F.create_map(*[F.lit(x) for k in kinds.items() for x in k]), F.col("codec")).cast("long")
            c.write_all({"compression_type": spark.createDataFrame([(i, n) for n, i in kinds.items()], "id long, value string"), "hash_compression_type": made.select("hash_id", number.alias("type_id")), "hash_sizes": made.select("hash_id", "writed_size", "compressed_size"), "block": made.select("hash_id", "data")})
        case "vacuum":
            return {n: c.vacuum(n) for n in ("block", "hash", "hash_sizes", "inode_hash_block", "inode", "tree", "name") if c.exists(n)}
    return None


def _blocks(t):
    kinds = t("hash_compression_type").join(F.broadcast(t("compression_type").select(F.col("id").alias("type_id"), F.col("value").alias("codec"))), "type_id").select("hash_id", "codec")  # a row for each codec
    rows = t("block").select("hash_id", "data").join(t("hash").select(F.col("id").alias("hash_id"), F.col("value").alias("digest")), "hash_id")
    return rows.join(kinds, "hash_id", "left").withColumn("codec", F.coalesce("codec", F.lit("none")))


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("cairn").getOrCreate()
    out = run(spark, sys.argv[1:])
    if hasattr(out, "toPandas"):
        for r in out.collect():
            print("\t".join(f"{k}={v}" for k, v in r.asDict().items()) if "--parsable" in sys.argv else r)
    elif out is not None:
        print(out)


if __name__ == "__main__":
    main()
