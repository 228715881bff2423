"""One query for each table of the store that drives its operations, and queries of the operations that change it; each with its SQL.

A query's rows are (op, n, s): an operation, how many rows it gives or leaves, and the sum of something about them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.functions.access import DIRECTORY, SYMLINK
from cairn.operators import blocks, gc, integrity, namespace, snapshots
from cairn.operators import tables as t
from cairn.plans.queries import INDEX, INODES, LIVE, LOG, SIZES, document_blocks, index, inodes, long, query, sizes
from cairn.sources.readers import table

AT = "2024-05-06 07:08:09"


def facts(**parts: tuple[DataFrame, str]) -> DataFrame:
    """op -> (rows, what is summed)."""
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(of)), F.lit(0)).cast("long").alias("s")) for op, (rows, of) in parts.items()])


def told(**parts: tuple[str, str]) -> str:
    """op -> (FROM clause, what is summed): the same in SQL."""
    return " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n, CAST(coalesce(sum({of}), 0) AS BIGINT) AS s FROM {rows}" for op, (rows, of) in parts.items())


def keys(spark: SparkSession, d: str, name: str = "x") -> DataFrame:
    """The suppliers' numbers: a set of ids."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias(name))


KEYS = "k AS (SELECT s_suppkey AS x FROM supplier)"


@query("o AS (SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region) " + told(insert=("(SELECT * FROM o UNION ALL SELECT 'more', '7')", "CAST(value AS INT)"), update=("(SELECT CASE WHEN name = 'ASIA' THEN '50' ELSE value END AS v FROM o)", "CAST(v AS INT)"), get=("o WHERE name = 'EUROPE'", "CAST(value AS INT)"), get_all=("o", "CAST(value AS INT)")))
def table_option(spark, d):
    o = t.Option(table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value")))
    every = o.get_all().select(F.explode(F.map_entries("options")).alias("e")).select("e.*")
    v = "cast(value as int)"
    return facts(insert=(o.insert(("more", "7")).rows, v), update=(o.update("ASIA", value="50").rows, v), get=(o.get("EUROPE"), v), get_all=(every, v))


SUBVOLUMES = "v AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS r, TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)) AS created_at FROM nation)"


def subvolumes(spark, d) -> t.Subvolume:
    key = F.col("n_nationkey").cast("long")
    made = F.timestamp_seconds(F.lit(1704067200) + key * 86400)
    none = F.lit(None).cast("timestamp")
    return t.Subvolume(table(spark, d, "nation").select(key.alias("id"), F.md5(F.col("n_name").cast("binary")).alias("hash"), F.col("n_name").alias("name"), (key % 2 == 0).alias("readonly"), F.when(key >= 0, "{}").alias("stats"), F.when(key >= 0, "{}").alias("root_diff"), (made + F.expr("interval 2 days")).alias("stats_at"), made.alias("root_diff_at"), made.alias("created_at"), none.alias("mounted_at"), (made + F.make_interval(days=(key % 4).cast("int"))).alias("updated_at")))


@query(SUBVOLUMES + " " + told(
    insert=("(SELECT id FROM v UNION ALL SELECT 99)", "id"), get_count=("v", "1"), readonly=("v WHERE id % 2 = 0 OR id = 3", "id"), mount_time=("v WHERE id = 4", "id"), update_time=("v WHERE id = 5", "id"), stats_time=("v WHERE id = 6", "id"),
    root_diff_time=("v WHERE id = 7", "id"), set_stats=("v WHERE id = 8", "id"), set_root_diff=("v WHERE id = 9", "id"), delete=("v WHERE id <> 10", "id"), get=("v WHERE id = 11", "id"), find=("v WHERE name = 'NATION_6'", "id"), get_ids=("(SELECT id FROM v ORDER BY name DESC LIMIT 3)", "id"), fresh=("v WHERE id % 4 <= 2", "id")))
def table_subvolume(spark, d):
    s = subvolumes(spark, d)
    stamped = lambda rows, c: rows.filter(F.col(c) == F.lit(AT).cast("timestamp"))
    more = s.insert_named(99, "more", dt.datetime(2024, 1, 1))
    return facts(
        insert=(more.rows, "id"), get_count=(counted(s), "1"), readonly=(s.readonly(3).rows.filter("readonly"), "id"), mount_time=(stamped(s.mount_time(4, AT).rows, "mounted_at"), "id"),
        update_time=(stamped(s.update_time(5, AT).rows, "updated_at"), "id"), stats_time=(stamped(s.stats_time(6, AT).rows, "stats_at"), "id"), root_diff_time=(stamped(s.root_diff_time(7, AT).rows, "root_diff_at"), "id"), set_stats=(s.set_stats(8, "x").rows.filter("stats = 'x'"), "id"),
        set_root_diff=(s.set_root_diff(9, "x").rows.filter("root_diff = 'x'"), "id"), delete=(s.delete(10).rows, "id"), get=(s.get(11), "id"), find=(s.find("NATION_6"), "id"), get_ids=(s.get_ids("name", True).limit(3), "id"), fresh=(s.fresh(), "id"),
    )


@query(f"{KEYS}, c AS (SELECT c_custkey AS id, c_name AS v FROM customer) " + told(insert=("(SELECT id FROM c UNION ALL SELECT -1)", "id"), find=("c WHERE v = 'Customer#000000007'", "id"), get=("c WHERE id = 9", "id"), get_count=("c", "1"), get_name_ids=("c WHERE id >= 10 AND id < 40", "id"), remove_by_ids=("c WHERE id NOT IN (SELECT x FROM k)", "id"), row_sizes=("c", "24 + 2 * strlen(v)")))
def table_name(spark, d):
    n = t.Name(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.md5(F.col("c_name").cast("binary")).alias("hash"), F.col("c_name").cast("binary").alias("value")))
    return facts(insert=(n.insert((-1, "", bytearray(b"x"))).rows, "id"), find=(n.find("Customer#000000007"), "id"), get=(n.get(9), "id"), get_count=(counted(n), "1"), get_name_ids=(n.get_ids_between(10, 40), "id"), remove_by_ids=(n.remove_by_ids(keys(spark, d)).rows, "id"), row_sizes=(n.row_sizes(), "row_size"))


def counted(x: t.Table) -> DataFrame:
    """As many rows as get_count says."""
    return x.get_count().select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt"))).alias("i"))


@query(f"{KEYS}, n AS (SELECT c_custkey AS id, c_nationkey AS p, c_custkey % 50 AS name, c_custkey // 2 AS i FROM customer) " + told(
    insert=("(SELECT id FROM n UNION ALL SELECT -1)", "id"), rename_inode=("n WHERE id = 5", "CAST(900 AS BIGINT)"), delete=("n WHERE id <> 6", "id"), find_by_parent_name=("n WHERE p = 3 AND name = 7", "id"), find_by_inode=("(SELECT min(id) AS id FROM n WHERE i = 20)", "id"), get=("n WHERE id = 8", "id"),
    get_children_inodes=("n WHERE p = 4", "i"), get_children=("(SELECT id FROM n WHERE p = 4 AND id > 30 ORDER BY id LIMIT 5)", "id"), get_inodes_by_inodes=("(SELECT DISTINCT i FROM n WHERE i IN (SELECT x FROM k))", "i"), get_all_inodes=("(SELECT DISTINCT i FROM n)", "i")))
def table_tree(spark, d):
    key = F.col("c_custkey").cast("long")
    x = t.Tree(table(spark, d, "customer").select(F.lit(1).cast("long").alias("subvol_id"), key.alias("id"), F.col("c_nationkey").cast("long").alias("parent_id"), (key % 50).alias("name_id"), F.floor(key / 2).cast("long").alias("inode_id")))
    return facts(
        insert=(x.insert((1, -1, 1, 1, 1)).rows, "id"), rename_inode=(x.rename(5, 900, 901).rows.filter("name_id = 901"), "parent_id"), delete=(x.delete(6).rows, "id"), find_by_parent_name=(x.find_by_parent_name(3, 7), "id"), find_by_inode=(x.find_by_inode(20), "id"), get=(x.get(8), "id"),
        get_children_inodes=(x.get_children_inodes(4), "inode_id"), get_children=(x.get_children(4, 30, 5), "id"), get_inodes_by_inodes=(x.get_inodes_by_inodes(keys(spark, d)), "inode_id"), get_all_inodes=(x.get_all_inodes(), "inode_id"),
    )


@query(f"{KEYS}, {INODES}, i AS (SELECT id, nlinks, id % 512 AS mode, size FROM inodes) " + told(
    insert=("(SELECT size FROM i UNION ALL SELECT 70)", "size"), update_data=("i WHERE id <> 1", "size"), get=("i WHERE id = 2", "size"), get_mode=("i WHERE id = 3", "mode"), get_size=("i WHERE id = 4", "size"), inc_nlinks=("i WHERE id = 5", "nlinks + 1"), dec_nlinks=("i WHERE id = 6", "nlinks - 1"),
    count_nlinks_by_ids=("i WHERE id IN (SELECT x FROM k) AND nlinks <> 0", "1"), get_count=("i", "1"), get_sizes=("(SELECT sum(size) AS s FROM i WHERE nlinks > 0)", "s"), get_sizes_by_id=("i WHERE id IN (SELECT x FROM k)", "size"), get_sizes_by_inodes=("(SELECT sum(size) AS s FROM i WHERE nlinks > 0 AND id IN (SELECT x FROM k))", "s"),
    get_inode_ids=("i WHERE id >= 100 AND id < 200", "id"), remove_by_ids=("i WHERE id NOT IN (SELECT x FROM k)", "id"), get_inodes_by_inodes=("i WHERE id IN (SELECT x FROM k)", "id")))
def table_inode(spark, d):
    zero = [F.lit(0).cast("long").alias(c) for c in ("uid", "gid", "rdev")]
    own = inodes(spark, d).select(F.lit(1).cast("long").alias("subvol_id"), F.col("id").cast("long").alias("id"), "nlinks", (F.col("id") % 512).cast("long").alias("mode"), *zero, "size", *[F.lit(0).cast("long").alias(c) for c in ("atime_ns", "mtime_ns", "ctime_ns")])
    i, k = t.Inode(own), keys(spark, d)
    many = lambda x: x.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("cnt"))).alias("i"))
    return facts(
        insert=(i.insert((1, -1, 1, 0, 0, 0, 0, 70, 0, 0, 0)).rows, "size"), update_data=(i.update_data(1, size=-5).rows.filter("size <> -5"), "size"), get=(i.get(2), "size"), get_mode=(i.get_mode(3), "mode"), get_size=(i.get_size(4), "size"), inc_nlinks=(i.inc_nlinks(5).get(5), "nlinks"),
        dec_nlinks=(i.dec_nlinks(6).get(6), "nlinks"), count_nlinks_by_ids=(many(i.count_nlinks_by_ids(k)), "1"), get_count=(counted(i), "1"), get_sizes=(i.get_sizes(), "size"), get_sizes_by_id=(i.get_sizes_by_id(k), "size"), get_sizes_by_inodes=(i.get_sizes_by_inodes(k), "size"),
        get_inode_ids=(i.get_ids_between(100, 200), "id"), remove_by_ids=(i.remove_by_ids(k).rows, "id"), get_inodes_by_inodes=(i.get_inodes_by_inodes(k), "id"),
    )


@query(f"{KEYS}, l AS (SELECT page_id AS i, url FROM pages), e AS (SELECT event_id AS i, event_type AS v FROM events) " + told(
    link_insert=("(SELECT i FROM l UNION ALL SELECT -1)", "i"), link_find=("l WHERE i = 3", "strlen(url)"), link_count=("l", "1"), link_ids=("l WHERE i >= 5 AND i < 50", "i"), link_remove=("l WHERE i NOT IN (SELECT x FROM k)", "i"),
    xattr_insert=("(SELECT i FROM e UNION ALL SELECT -1)", "i"), xattr_update=("e WHERE i = 4", "i"), xattr_find=("e WHERE i = 5", "strlen(v)"), xattr_count=("e", "1"), xattr_ids=("e WHERE i >= 5 AND i < 50", "i"), xattr_remove=("e WHERE i NOT IN (SELECT x FROM k)", "i")))
def table_link_and_xattr(spark, d):
    one, k = F.lit(1).cast("long").alias("subvol_id"), keys(spark, d)
    ln = t.Link(table(spark, d, "pages").select(one, F.col("page_id").cast("long").alias("inode_id"), F.col("url").cast("binary").alias("target")))
    x = t.Xattr(table(spark, d, "events").select(one, F.col("event_id").cast("long").alias("inode_id"), F.create_map(F.lit("user.kind"), F.col("event_type").cast("binary")).alias("attrs")))
    changed = x.upsert(x.get(4).withColumn("attrs", namespace.xattr_set(F.col("attrs"), "user.new", F.lit(b"1"))))
    return facts(
        link_insert=(ln.insert((1, -1, bytearray(b"x"))).rows, "inode_id"), link_find=(ln.find_by_inode(3), "octet_length(target)"), link_count=(counted(ln), "1"), link_ids=(ln.get_ids_between(5, 50), "inode_id"), link_remove=(ln.remove_by_ids(k).rows, "inode_id"),
        xattr_insert=(x.insert((1, -1, {})).rows, "inode_id"), xattr_update=(namespace.xattr_get(changed.rows, "user.new"), "inode_id"), xattr_find=(x.find(5), "octet_length(attrs['user.kind'])"), xattr_count=(counted(x), "1"), xattr_ids=(x.get_ids_between(5, 50), "inode_id"), xattr_remove=(x.remove_by_ids(k).rows, "inode_id"),
    )


@query(f"{INDEX}, {KEYS}, o AS (SELECT min(inode_id) AS i FROM idx) " + told(
    insert=("(SELECT hash_id FROM idx UNION ALL SELECT 5)", "hash_id"), update=("idx WHERE inode_id = (SELECT i FROM o) AND block_number = 1", "70"), update_hash=("idx WHERE inode_id = (SELECT i FROM o) AND block_number = 1", "-7"), update_size=("idx WHERE inode_id = (SELECT i FROM o) AND block_number = 1", "-8"),
    delete=("idx WHERE inode_id <> (SELECT i FROM o)", "hash_id"), get=("idx WHERE inode_id = (SELECT i FROM o) AND block_number = 1", "hash_id"), hash_by_inode_number=("idx WHERE inode_id = (SELECT i FROM o) AND block_number = 1", "hash_id"),
    delete_by_inode_number=("idx WHERE NOT (inode_id = (SELECT i FROM o) AND block_number = 1)", "hash_id"), delete_more=("idx WHERE NOT (inode_id = (SELECT i FROM o) AND block_number > 1)", "hash_id"), beyond=("idx WHERE inode_id = (SELECT i FROM o) AND block_number > 1", "hash_id"),
    get_count_uniq_inodes=("(SELECT count(DISTINCT inode_id) AS c FROM idx)", "c"), get_uniq_hashes=("(SELECT DISTINCT hash_id FROM idx)", "hash_id"), count_hashes=("(SELECT count(*) AS c FROM idx WHERE hash_id IN (SELECT x FROM k))", "c"), count_realsize=("(SELECT sum(real_size) AS c FROM idx WHERE hash_id IN (SELECT x FROM k))", "c"),
    get_inode_ids=("(SELECT DISTINCT inode_id FROM idx WHERE inode_id >= 100 AND inode_id < 300)", "inode_id"), remove_by_inodes=("idx WHERE inode_id NOT IN (SELECT x FROM k)", "hash_id"), get_hashid_by_inodes=("idx WHERE inode_id IN (SELECT x FROM k)", "hash_id"), get_hash_inode_ids=("idx", "hash_id + inode_id")))
def table_inode_hash_block(spark, d):
    own = index(spark, d).select(F.lit(1).cast("long").alias("subvol_id"), F.col("inode_id").cast("long").alias("inode_id"), F.col("block_number").cast("long").alias("block_number"), F.col("hash_id").cast("long").alias("hash_id"), "real_size")
    x, k = t.InodeHashBlock(own), keys(spark, d)
    i = own.agg(F.min("inode_id")).first()[0]
    kept, beyond = x.delete_by_inode_number_more(i, 1)
    return facts(
        insert=(x.insert((1, -1, 0, 5, 1)).rows, "hash_id"), update=(x.update(i, 1, real_size=70).get(i, 1), "real_size"), update_hash=(x.update_hash(i, 1, -7).get(i, 1), "hash_id"), update_size=(x.update_size(i, 1, -8).get(i, 1), "real_size"), delete=(x.delete_inode(i).rows, "hash_id"), get=(x.get(i, 1), "hash_id"),
        hash_by_inode_number=(x.hash_by_inode_number(i, 1), "hash_id"), delete_by_inode_number=(x.delete_by_inode_number(i, 1).rows, "hash_id"), delete_more=(kept.rows, "hash_id"), beyond=(beyond, "hash_id"), get_count_uniq_inodes=(x.get_count_uniq_inodes(), "cnt"), get_uniq_hashes=(x.get_uniq_hashes(), "hash_id"),
        count_hashes=(x.count_hashes_by_hashes(k), "cnt"), count_realsize=(x.count_realsize_by_hashes(k), "size"), get_inode_ids=(x.get_ids_between(100, 300), "inode_id"), remove_by_inodes=(x.remove_by_inodes(k).rows, "hash_id"), get_hashid_by_inodes=(x.get_hashid_by_inodes(k), "hash_id"), get_hash_inode_ids=(x.get_hash_inode_ids(), "hash_id + inode_id"),
    )


@query("i AS (SELECT s_suppkey AS k, CAST(512 AS INT) AS b FROM supplier), p AS (SELECT r_name AS k, CAST(1024 AS INT) AS b FROM region) " + told(
    inode_insert=("(SELECT b FROM i UNION ALL SELECT 7)", "b"), inode_update=("i WHERE k = 2", "9"), inode_compression=("i WHERE k = 3", "b"), inode_block_size=("i WHERE k = 4", "4096"), inode_get=("i WHERE k = 5", "b"),
    pattern_insert=("(SELECT b FROM p UNION ALL SELECT 7)", "b"), pattern_update=("p WHERE k = 'ASIA'", "9"), pattern_compression=("p WHERE k = 'ASIA'", "b"), pattern_block_size=("p WHERE k = 'ASIA'", "4096"), pattern_all=("p", "b")))
def table_overrides(spark, d):
    i = t.InodeOption(keys(spark, d, "inode").select("inode", F.lit(512).alias("block_size"), F.lit("none").alias("compression")))
    p = t.NamePatternOption(table(spark, d, "region").select(F.col("r_name").alias("pattern"), F.lit(1024).alias("block_size"), F.lit("none").alias("compression")))
    return facts(
        inode_insert=(i.insert((-1, 7, "x")).rows, "block_size"), inode_update=(i.update(2, block_size=9).get(2), "block_size"), inode_compression=(i.update_compression(3, "zstd").rows.filter("compression = 'zstd'"), "block_size"), inode_block_size=(i.update_block_size(4, 4096).get(4), "block_size"), inode_get=(i.get(5), "block_size"),
        pattern_insert=(p.insert(("x", 7, "x")).rows, "block_size"), pattern_update=(p.update("ASIA", block_size=9).get("ASIA"), "block_size"), pattern_compression=(p.update_compression("ASIA", "zstd").rows.filter("compression = 'zstd'"), "block_size"), pattern_block_size=(p.update_block_size("ASIA", 4096).get("ASIA"), "block_size"), pattern_all=(p.get_all(), "block_size"),
    )


@query(f"{KEYS}, h AS (SELECT p_partkey AS id, p_name AS v FROM part) " + told(
    insert=("(SELECT id FROM h UNION ALL SELECT -1)", "id"), insert_raw=("(SELECT id FROM h UNION ALL SELECT x + 1000000 FROM k)", "id"), update=("h WHERE id = 3", "id"), get=("h WHERE id = 4", "id"), find=("h WHERE id = 7", "id"), get_count=("h", "1"), get_hash_ids=("h WHERE id >= 10 AND id < 20", "id"), remove_by_ids=("h WHERE id NOT IN (SELECT x FROM k)", "id"),
    block_insert=("(SELECT v FROM h UNION ALL SELECT 'xyz')", "strlen(v)"), block_update=("h WHERE id = 5", "2"), block_get=("h WHERE id = 6", "strlen(v)"), block_remove=("h WHERE id NOT IN (SELECT x FROM k)", "strlen(v)"),
    parts_insert=("(SELECT id FROM h WHERE id % 7 = 2 UNION ALL SELECT 7000002)", "id"), parts_update=("h WHERE id = 5", "2"), parts_get=("h WHERE id = 6", "strlen(v)"), parts_part=("h WHERE id % 7 = 3", "strlen(v)"), parts_remove=("h WHERE id NOT IN (SELECT x FROM k)", "strlen(v)")))
def table_hash_and_block(spark, d):
    part, k = table(spark, d, "part"), keys(spark, d)
    key = F.col("p_partkey").cast("long")
    h = t.Hash(part.select(key.alias("id"), F.md5(key.cast("string").cast("binary")).alias("value")))
    rows = part.select(key.alias("hash_id"), F.col("p_name").cast("binary").alias("data"))
    b, p, size = t.Block(rows), t.BlockParts(rows, 7), "octet_length(data)"
    more = keys(spark, d).select((F.col("x") + 1000000).alias("id"), F.lit("raw").alias("value"))
    return facts(
        insert=(h.insert((-1, "new")).rows, "id"), insert_raw=(h.insert(more).rows, "id"), update=(h.update(3, value="x").find("x"), "id"), get=(h.get(4), "id"), find=(h.find(hashlib.md5(b"7").hexdigest()), "id"), get_count=(counted(h), "1"), get_hash_ids=(h.get_ids_between(10, 20), "id"), remove_by_ids=(h.remove_by_ids(k).rows, "id"),
        block_insert=(b.insert((-1, bytearray(b"xyz"))).rows, size), block_update=(b.update(5, data=bytearray(b"ab")).get(5), size), block_get=(b.get(6), size), block_remove=(b.remove_by_ids(k).rows, size),
        parts_insert=(p.insert((7000002, bytearray(b"x"))).get_part(2), "hash_id"), parts_update=(p.update(5, data=bytearray(b"ab")).get(5), size), parts_get=(p.get(6), size), parts_part=(p.get_part(3), size), parts_remove=(p.remove_by_ids(k).rows, size),
    )


@query(f"{SIZES}, {KEYS}, c AS (SELECT DISTINCT p_brand AS v, CAST(substr(p_brand, 7) AS BIGINT) AS id FROM part) " + told(
    sizes_insert=("(SELECT compressed_size AS z FROM sizes UNION ALL SELECT 3)", "z"), sizes_update=("sizes WHERE hash_id = 2", "4"), sizes_get=("sizes WHERE hash_id = 3", "compressed_size"), sizes_remove=("sizes WHERE hash_id NOT IN (SELECT x FROM k)", "compressed_size"), sizes_by_ids=("sizes WHERE hash_id IN (SELECT x FROM k)", "writed_size"),
    median=("(SELECT CAST(floor(median(compressed_size)) AS BIGINT) AS z FROM sizes)", "z"), mean=("(SELECT CAST(floor(avg(compressed_size)) AS BIGINT) AS z FROM sizes)", "z"),
    type_insert=("(SELECT hash_id FROM sizes UNION ALL SELECT -1)", "hash_id"), type_update=("sizes WHERE hash_id = 2", "99"), type_get=("sizes WHERE hash_id = 3", "CAST(substr(codec, 7) AS BIGINT)"), type_remove=("sizes WHERE hash_id NOT IN (SELECT x FROM k)", "hash_id"), type_by_ids=("sizes WHERE hash_id IN (SELECT x FROM k)", "CAST(substr(codec, 7) AS BIGINT)"),
    codec_insert=("(SELECT id FROM c UNION ALL SELECT 7)", "id"), codec_update=("c WHERE id = 11", "id"), codec_get=("c WHERE id = 12", "id"), codec_find=("c WHERE v = 'Brand#13'", "id"), codec_all=("c", "id"), codec_revert=("c", "id")))
def table_sizes_and_codecs(spark, d):
    k, brand = keys(spark, d), F.substring("p_brand", 7, 9).cast("long")
    s = t.HashSizes(sizes(spark, d).withColumn("hash_id", F.col("hash_id").cast("long")))
    h = t.HashCompressionType(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("hash_id"), brand.alias("type_id")))
    c = t.CompressionType(table(spark, d, "part").select(brand.alias("id"), F.col("p_brand").alias("value")).distinct())
    pairs = lambda x, of: x.select(F.explode(F.map_entries("types")).alias("e")).select(F.col(f"e.{of}").alias("id"))
    z = "compressed_size"
    return facts(
        sizes_insert=(s.insert((-1, 3, 3)).rows, z), sizes_update=(s.update(2, compressed_size=4).get(2), z), sizes_get=(s.get(3), z), sizes_remove=(s.remove_by_ids(k).rows, z), sizes_by_ids=(s.get_sizes_by_hash_ids(k), "writed_size"), median=(s.get_median_compressed_size(), "floor(median)"), mean=(s.get_mean_compressed_size(), "floor(mean)"),
        type_insert=(h.insert((-1, 1)).rows, "hash_id"), type_update=(h.update(2, type_id=99).get(2), "type_id"), type_get=(h.get(3), "type_id"), type_remove=(h.remove_by_ids(k).rows, "hash_id"), type_by_ids=(h.get_types_by_hash_ids(k), "type_id"),
        codec_insert=(c.insert((7, "x")).rows, "id"), codec_update=(c.update(11, value="x").find("x"), "id"), codec_get=(c.get(12), "id"), codec_find=(c.find("Brand#13"), "id"), codec_all=(pairs(c.get_all(), "key"), "id"), codec_revert=(pairs(c.get_all_revert(), "value"), "id"),
    )


@query(f"{LOG}, {KEYS}, c AS (SELECT hash_id, count(*) AS n FROM log GROUP BY 1), o AS (SELECT DISTINCT hash_id, l_suppkey AS u FROM log) " + told(
    insert=("log", "hash_id"), find=("c WHERE hash_id = 5", "hash_id"), inc=("c", "n + CASE WHEN hash_id IN (1, 2) THEN 1 ELSE 0 END"), dec=("c", "n - CASE WHEN hash_id IN (1, 2) THEN 1 ELSE 0 END"), get_unused=("c WHERE hash_id IN (SELECT x FROM k)", "hash_id"), count_unused=("(SELECT count(*) AS z FROM c WHERE hash_id IN (SELECT x FROM k))", "z"),
    has_owner=("o WHERE hash_id = 5 AND u = (SELECT min(u) FROM o WHERE hash_id = 5)", "hash_id"), add_owner=("(SELECT * FROM o UNION SELECT x, -1 FROM k)", "u"), owner_remove=("o WHERE hash_id NOT IN (SELECT x FROM k)", "u"), ids_insert=("(SELECT x FROM k UNION ALL SELECT -1)", "x"), ids_find=("k WHERE x = 3", "x"), ids_by_ids=("k WHERE x IN (SELECT hash_id FROM c)", "x"),
    id_count_insert=("k", "x"), id_count_find=("k WHERE x = 4", "x"), id_count_inc=("k", "CASE WHEN x = 4 THEN 2 ELSE 1 END")))
def table_counts_and_owners(spark, d):
    log, k = table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("hash_id"), F.col("l_suppkey").cast("long").alias("owner")), keys(spark, d)
    c = t.HashCount(log.select("hash_id", F.lit(1).cast("long").alias("delta")))
    gone = t.HashCount(c.rows.unionByName(c.counts().join(k.withColumnRenamed("x", "hash_id"), "hash_id", "left_semi").select("hash_id", (-F.col("cnt")).alias("delta"))))
    o = t.HashOwner(log.select("hash_id", F.col("owner").cast("string").alias("uuid")).distinct())
    first = str(log.filter("hash_id = 5").agg(F.min("owner")).first()[0])
    i, n = t.TmpIds(keys(spark, d, "id")), t.TmpIdCount(keys(spark, d, "id").withColumn("delta", F.lit(1).cast("long")))
    return facts(
        insert=(c.rows, "hash_id"), find=(c.find(5), "hash_id"), inc=(c.inc(1, 2).counts(), "cnt"), dec=(c.dec(1, 2).counts(), "cnt"), get_unused=(gone.get_unused_hashes(), "hash_id"), count_unused=(gone.count_unused_hashes(), "cnt"), has_owner=(o.hash_has_owner(5, first), "hash_id"),
        add_owner=(o.add_hash_owner(keys(spark, d, "hash_id").withColumn("uuid", F.lit("-1"))).rows, "cast(uuid as long)"), owner_remove=(o.remove_by_ids(k).rows, "cast(uuid as long)"), ids_insert=(i.insert((-1,)).rows, "id"), ids_find=(i.find(3), "id"), ids_by_ids=(i.get_ids_by_ids(c.counts().select("hash_id")), "id"),
        id_count_insert=(n.rows, "id"), id_count_find=(n.find(4), "id"), id_count_inc=(n.inc(4).counts(), "cnt"),
    )


# ---- snapshots


def store_of(spark, d) -> dict[str, DataFrame]:
    """tree, inode and index of the nations as subvolumes: customers are nodes, orders inodes."""
    c = table(spark, d, "customer")
    tree = c.select(F.col("c_nationkey").cast("long").alias("subvol_id"), F.col("c_custkey").cast("long").alias("id"), F.lit(1).cast("long").alias("parent_id"), F.col("c_custkey").cast("long").alias("name_id"), F.col("c_custkey").cast("long").alias("inode_id"))
    zero = [F.lit(0).cast("long").alias(x) for x in ("uid", "gid", "rdev")]
    inode = tree.select("subvol_id", "id", F.lit(1).cast("long").alias("nlinks"), F.lit(0o100644).cast("long").alias("mode"), *zero, (F.col("id") * 10).alias("size"), *[F.lit(0).cast("long").alias(x) for x in ("atime_ns", "mtime_ns", "ctime_ns")])
    return {"tree": tree, "inode": inode}


STORE = SUBVOLUMES + ", tree AS (SELECT c_nationkey AS subvol_id, c_custkey AS id FROM customer)"


@query(STORE + " " + told(subvolume=("(SELECT id FROM v UNION ALL SELECT 99)", "id"), readonly=("(SELECT id FROM v WHERE id % 2 = 0 UNION ALL SELECT 99)", "id"), tree=("(SELECT * FROM tree UNION ALL SELECT 99, id FROM tree WHERE subvol_id = 6)", "subvol_id + id"), inode=("(SELECT * FROM tree UNION ALL SELECT 99, id FROM tree WHERE subvol_id = 6)", "subvol_id + id * 10")))
def snapshot_make(spark, d):
    made, out = snapshots.make(subvolumes(spark, d).rows, store_of(spark, d), "NATION_6", "snap", 99, dt.datetime(2024, 5, 6))
    return facts(subvolume=(made, "id"), readonly=(made.filter("readonly"), "id"), tree=(out["tree"], "subvol_id + id"), inode=(out["inode"], "subvol_id + size"))


@query(STORE + f", {INDEX}, {SIZES}, x AS (SELECT l_suppkey % 25 AS subvol_id, hash_id FROM idx), f AS (SELECT * FROM sizes WHERE hash_id IN (SELECT hash_id FROM x WHERE subvol_id = 6) AND hash_id NOT IN (SELECT hash_id FROM x WHERE subvol_id <> 6)) " + told(subvolume=("v WHERE id <> 6", "id"), tree=("tree WHERE subvol_id <> 6", "id"), inode=("tree WHERE subvol_id <> 6", "id * 10"), freed=("(SELECT count(*) AS z FROM f)", "z"), freed_bytes=("(SELECT coalesce(sum(compressed_size), 0) AS z FROM f)", "z")))
def snapshot_remove(spark, d):
    left, out = snapshots.remove(subvolumes(spark, d).rows, store_of(spark, d), "NATION_6")
    own = index(spark, d).select((F.col("l_suppkey") % 25).cast("long").alias("subvol_id"), "hash_id")
    free = snapshots.freed(own, spark.createDataFrame([(6,)], "subvol_id long"), sizes(spark, d))
    return facts(subvolume=(left, "id"), tree=(out["tree"], "id"), inode=(out["inode"], "size"), freed=(free, "hashes"), freed_bytes=(free, "compressed_size"))


@query(STORE + " " + told(subvolume=("(SELECT id FROM v UNION ALL SELECT 99)", "id"), again=("v", "id"), tree=("(SELECT id FROM tree UNION ALL SELECT 1)", "id"), inode=("(SELECT id * 10 AS s FROM tree UNION ALL SELECT 0)", "s"), folder=("(SELECT 1)", "2")))
def subvolume_create(spark, d):
    s, own = subvolumes(spark, d).rows, store_of(spark, d)
    now = dt.datetime(2024, 5, 6)
    made, i, tree = snapshots.create(s, own["inode"], own["tree"], 99, "new", now)
    again, _, _ = snapshots.create(s, own["inode"], own["tree"], 99, "NATION_6", now)
    return facts(subvolume=(made, "id"), again=(again, "id"), tree=(tree, "id"), inode=(i, "size"), folder=(i.filter(F.col("mode") == 0o040755), "nlinks"))


@query(SUBVOLUMES + " " + told(flag=("v WHERE id % 2 = 0 OR name = 'NATION_7'", "id"), stats=("v WHERE name <> 'NATION_7'", "id"), diffs=("v WHERE id < 0", "id"), stats_fresh=("v WHERE id % 4 <= 2", "id"), diff_fresh=("v WHERE id % 4 = 0 AND id > 0", "id")))
def stats_invalidate(spark, d):
    s = subvolumes(spark, d).rows
    rooted = s.withColumn("name", F.when(F.col("id") == 0, "@root").otherwise(F.col("name")))
    fresh = snapshots.fresh(rooted).join(rooted.select("name", "id"), "name")
    return facts(flag=(snapshots.readonly(s, "NATION_7", True).filter("readonly"), "id"), stats=(snapshots.without_stats(s, "NATION_7").filter("stats is not null"), "id"), diffs=(snapshots.without_stats(s).filter("root_diff is not null"), "id"), stats_fresh=(fresh.filter("stats_fresh"), "id"), diff_fresh=(fresh.filter("diff_fresh and id > 0"), "id"))


@query(SUBVOLUMES + ", keep AS (SELECT max(created_at) AS c FROM v WHERE id > 0 GROUP BY date_diff('day', created_at, TIMESTAMP '2024-01-25 12:00:00') HAVING date_diff('day', max(created_at), TIMESTAMP '2024-01-25 12:00:00') BETWEEN 0 AND 6) SELECT name FROM v WHERE id > 0 AND created_at NOT IN (SELECT c FROM keep)")
def retention_remove_by_plan(spark, d):
    """Snapshots that a plan of seven days removes; the root, the oldest, is none of them."""
    s = subvolumes(spark, d).rows.withColumn("name", F.when(F.col("id") == 0, "@root").otherwise(F.col("name")))
    return snapshots.removed_by_plan(s, "2024-01-25 12:00:00", snapshots.Plan(7, 0, 0, 0)).select("name")


# ---- blocks and names that change


@query(f"{LOG}, {INODES}, z AS (SELECT inode_id, block_number - 1 AS b, hash_id, CASE WHEN hash_id < 500 THEN 0 ELSE real_size END AS r FROM log) SELECT inode_id, b AS block_number, hash_id, CAST(CASE WHEN r > 0 THEN r ELSE coalesce(greatest(least(size - b * 65536, 65536), 0), 0) END AS BIGINT) AS real_size FROM z LEFT JOIN inodes ON id = inode_id")
def sizes_repair(spark, d):
    """Index rows without a size get what their file's size leaves for them."""
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), (F.col("l_linenumber") - 1).alias("block_number"), F.col("l_partkey").alias("hash_id"), F.when(F.col("l_partkey") < 500, 0).otherwise(long("l_quantity")).cast("long").alias("real_size"))
    return blocks.repaired_sizes(own, inodes(spark, d).select("id", "size"), 65536).select("inode_id", "block_number", "hash_id", "real_size")


@query("b AS (SELECT p_partkey AS hash_id, CASE p_type WHEN 'STANDARD' THEN 'none' WHEN 'ECONOMY' THEN 'zlib' WHEN 'MEDIUM' THEN 'zstd' WHEN 'PROMO' THEN 'bz2' ELSE 'lz4' END AS codec FROM part) SELECT codec, count(*) AS cnt FROM b WHERE codec IN ('lz4', 'bz2') GROUP BY 1")
def recompress_needed(spark, d):
    """Blocks in a deprecated codec (lz4), or in one that isn't configured (bz2)."""
    m = F.col("p_type")
    codec = F.when(m == "STANDARD", "none").when(m == "ECONOMY", "zlib").when(m == "MEDIUM", "zstd").when(m == "PROMO", "bz2").otherwise("lz4")
    own = table(spark, d, "part").select(F.col("p_partkey").alias("hash_id"), codec.alias("codec"))
    return integrity.to_recompress(own, EngineConfig(codecs=("zlib", "zstd", "lz4")), ("lz4",)).groupBy("codec").agg(F.count(F.lit(1)).alias("cnt"))


@query("f AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), w AS (SELECT doc_id, hex(b) AS h FROM f WHERE octet_length(b) > 3000), n AS (SELECT doc_id, substring(h, 1, 2000) || repeat('21', 2000) || substring(h, 6001) AS h FROM w), c AS (SELECT doc_id, i AS block_number, substring(h, CAST(i * 2048 + 1 AS BIGINT), 2048) AS x FROM n, unnest(range(CAST(ceil(length(h) / 2048.0) AS BIGINT))) AS t(i)) SELECT doc_id AS inode_id, block_number, md5(unhex(x)) AS digest, CAST(length(x) / 2 AS BIGINT) AS real_size FROM c")
def write_at_an_offset(spark, d):
    """Two overlapping writes of 2000 bytes in all at byte 1000 of every file of over 3000 bytes."""
    own = document_blocks(spark, d).select(F.col("doc_id").alias("inode_id"), "block_number", F.col("stored").alias("data"), "digest", "real_size")
    large = table(spark, d, "documents").filter(F.octet_length(F.encode("text", "UTF-8")) > 3000).select(F.col("doc_id").alias("inode_id"))
    own = own.join(large, "inode_id", "left_semi")
    put = lambda seq, at, x, n: large.select("inode_id", F.lit(seq).cast("long").alias("seq"), F.lit(at).cast("long").alias("offset"), F.lit(x * n).alias("data"))
    changed = blocks.merged_writes(own, put(1, 1000, b"?", 1500).unionByName(put(2, 1000, b"!", 1800)).unionByName(put(3, 2000, b"!", 1000)), 1024)
    return blocks.rewritten(own, changed)[0]


@query("e AS (SELECT event_id AS seq, user_id AS id, event_type AS kind, CAST(floor(value) AS BIGINT) AS v FROM events), u AS (SELECT DISTINCT id FROM e), s AS (SELECT id, max_by(v, seq) FILTER (WHERE kind = 'click') AS size, max_by(v, seq) FILTER (WHERE kind <> 'click') AS mode FROM e GROUP BY 1) SELECT u.id, coalesce(s.size, 1000) AS size, coalesce(s.mode, 7) AS mode, coalesce(s.size, 1000) < 1000 AS truncated FROM u JOIN s USING (id)")
def setattr_last_wins(spark, d):
    """Clicks set sizes, all other events modes; of each the last holds, and a smaller size truncates."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "click", long("value")).alias("size"), F.when(F.col("event_type") != "click", long("value")).alias("mode"))
    own = e.select("id").distinct().withColumn("size", F.lit(1000).cast("long")).withColumn("mode", F.lit(7).cast("long"))
    return namespace.apply_setattr(own, e)


@query("l AS (SELECT page_id AS inode_id, url AS target, url LIKE 'https%' AS link FROM pages) SELECT inode_id, target FROM l WHERE link")
def readlink(spark, d):
    """The targets of inodes that are symbolic links; those of other kinds aren't given."""
    p = table(spark, d, "pages")
    own = p.select(F.col("page_id").alias("id"), F.when(F.col("url").startswith("https"), SYMLINK | 0o777).otherwise(0o100644).cast("long").alias("mode"))
    return namespace.readlink(p.select(F.col("page_id").alias("inode_id"), F.col("url").alias("target")), own)


@query(f"{INODES}, a AS (SELECT l_orderkey AS inode_id, count(*) AS n FROM lineitem GROUP BY 1) " + told(xattr=(f"a WHERE inode_id NOT IN (SELECT id FROM inodes WHERE {LIVE})", "inode_id"), link=(f"a WHERE inode_id NOT IN (SELECT id FROM inodes WHERE {LIVE})", "n")))
def gc_xattrs_and_links(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("inode_id")).agg(F.count(F.lit(1)).alias("n"))
    live = inodes(spark, d).filter(LIVE)
    return facts(xattr=(gc.dead_of_inodes(rows, live), "inode_id"), link=(gc.dead_of_inodes(rows, live), "n"))


@query("""c AS (SELECT c_custkey + 1000 AS id, c_nationkey + 100 AS p, c_mktsegment AS g FROM customer), left_ AS (SELECT id, CASE WHEN g = 'BUILDING' THEN 100 ELSE p END AS p FROM c WHERE g <> 'MACHINERY'),
all_ AS (SELECT id, p FROM left_ UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation UNION ALL SELECT 10**9 + n_nationkey, n_nationkey + 100 FROM nation), f AS (SELECT DISTINCT c_nationkey + 100 AS p FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT 'node' AS op, count(*) AS n, CAST(sum(id + p) AS BIGINT) AS s FROM all_ UNION ALL SELECT 'links', count(*), CAST(sum(CASE WHEN g = 'MACHINERY' THEN 0 ELSE 1 END) AS BIGINT) FROM c UNION ALL SELECT 'refused', count(*), CAST(coalesce(sum(p), 0) AS BIGINT) FROM f""".replace("10**9", "1000000000"))
def namespace_events(spark, d):
    """Customers are files in nations' folders: one segment's are unlinked, another's move to one folder, each folder gets a new file; then the folders that have files refuse to go."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key, folder = (F.col("c_custkey") + 1000).cast("long"), (F.col("c_nationkey") + 100).cast("long")
    own = (F.col("n_nationkey") + 100).cast("long")
    tree = c.select(key.alias("id"), folder.alias("parent_id"), key.alias("name_id"), key.alias("inode_id")).unionByName(n.select(own.alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), own.alias("name_id"), own.alias("inode_id")))
    i = c.select(key.alias("id"), F.lit(1).cast("long").alias("nlinks"), F.lit(0o100644).cast("long").alias("mode")).unionByName(n.select(own.alias("id"), F.lit(2).cast("long").alias("nlinks"), F.lit(DIRECTORY | 0o755).cast("long").alias("mode")))
    none, seg = F.lit(None).cast("long"), F.col("c_mktsegment")
    made = (F.col("n_nationkey") + 1_000_000_000).cast("long")
    first = c.filter(seg.isin("MACHINERY", "BUILDING")).select(key.alias("seq"), F.when(seg == "MACHINERY", "unlink").otherwise("rename").alias("op"), key.alias("node_id"), F.when(seg == "BUILDING", F.lit(100).cast("long")).alias("parent_id"), F.when(seg == "BUILDING", key).alias("name_id"), none.alias("inode_id"), none.alias("mode"))
    new = n.select((own + 10_000_000).alias("seq"), F.lit("create").alias("op"), made.alias("node_id"), own.alias("parent_id"), made.alias("name_id"), made.alias("inode_id"), F.lit(0o100644).cast("long").alias("mode"))
    asked = n.select((own + 5_000_000).alias("seq"), F.lit("rmdir").alias("op"), own.alias("node_id"), none.alias("parent_id"), none.alias("name_id"), none.alias("inode_id"), none.alias("mode"))
    early = c.filter(seg == "MACHINERY").select(key.alias("seq"), F.lit("unlink").alias("op"), key.alias("node_id"), none.alias("parent_id"), none.alias("name_id"), none.alias("inode_id"), none.alias("mode"))
    nodes, links = namespace.apply_events(tree, i, first.unionByName(new))
    return facts(node=(nodes, "id + parent_id"), links=(links.join(c.select(key.alias("id")), "id", "left_semi"), "nlinks"), refused=(namespace.refused(tree, i, early.unionByName(asked)), "node_id"))
