import datetime as dt

from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.operators import tables as t
from cairn.sources.catalog import Catalog


def make(spark, kind, *rows):
    from pyspark.sql.types import _parse_datatype_string

    return kind(spark.createDataFrame(list(rows), _parse_datatype_string(t.SCHEMAS[kind.name])))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def test_options_and_overrides(spark):
    o = make(spark, t.Option, ("a", "1")).insert(("b", "2")).update("a", value="3")
    assert o.get_all().first().options == {"a": "3", "b": "2"} and o.get("b").first().value == "2" and o.get_count().first()[0] == 2
    p = make(spark, t.NamePatternOption, ("*.jpg", 4096, "none"), ("*", 512, "zstd")).update_compression("*", "lz4")
    names = spark.createDataFrame([("a.jpg",), ("b.txt",)], "name string")
    assert {r.name: (r.pattern, r.compression) for r in p.matching(names, "name").collect()} == {"a.jpg": ("*.jpg", "none"), "b.txt": ("*", "lz4")}
    assert make(spark, t.InodeOption, (1, 512, "none")).update_block_size(1, 1024).get(1).first().block_size == 1024


def test_subvolumes(spark):
    now = dt.datetime(2024, 1, 2)
    s = make(spark, t.Subvolume).insert_named(1, "@root", now).insert_named(2, "b", now + dt.timedelta(1), updated_at=now)
    assert s.find("b").first().id == 2 and [r.id for r in s.get_ids("created_at", True).collect()] == [2, 1]
    s = s.readonly(2).set_stats(2, "{}").stats_time(2, "2024-01-03 00:00:00").mount_time(2).root_diff_time(2).set_root_diff(2, "{}").update_time(1, "2024-01-01 00:00:00")
    assert s.get(2).first().readonly and not s.get(1).first().readonly and s.fresh().count() == 1 and s.delete(2).get_count().first()[0] == 1


def test_tree_inode_and_index(spark):
    tree = make(spark, t.Tree, (1, 1, None, 10, 1), (1, 2, 1, 11, 2), (1, 3, 1, 12, 2))
    assert tree.find_by_inode(2).first().id == 2 and tree.find_by_parent_name(1, 12).first().id == 3
    assert [r.id for r in tree.get_children(1, 2).collect()] == [3] and tree.get_all_inodes().count() == 2
    assert tree.rename(3, 2, 13).get(3).first().parent_id == 2 and tree.get_inodes_by_inodes(ids(spark, 2, 9)).count() == 1
    inode = make(spark, t.Inode, (1, 1, 2, 0, 0, 0, 0, 7, 0, 0, 0), (1, 2, 0, 0, 0, 0, 0, 9, 0, 0, 0))
    assert inode.get_sizes().first().size == 7 and inode.inc_nlinks(2).get_sizes().first().size == 16 and inode.dec_nlinks(1).get(1).first().nlinks == 1
    assert inode.count_nlinks_by_ids(ids(spark, 1, 2)).first().cnt == 1 and inode.get_sizes_by_inodes(ids(spark, 2)).first().size == 0
    assert inode.add_links(spark.createDataFrame([(1, 2), (1, -1)], "id long, delta long")).get(1).first().nlinks == 3
    index = make(spark, t.InodeHashBlock, (1, 1, 0, 5, 4), (1, 1, 1, 6, 4), (1, 2, 0, 5, 3))
    assert index.get_count_uniq_inodes().first().cnt == 2 and index.get_uniq_hashes().count() == 2
    assert index.count_realsize_by_hashes(ids(spark, 5)).first().size == 7 and index.count_hashes_by_hashes(ids(spark, 6)).first().cnt == 1
    kept, cut = index.delete_by_inode_number_more(1, 0)
    assert kept.rows.count() == 2 and cut.first().hash_id == 6
    assert index.update_hash(1, 1, 9).get(1, 1).first().hash_id == 9 and index.delete(1, 1).rows.count() == 2 and index.remove_by_inodes(ids(spark, 1)).rows.count() == 1
    assert index.get_ids_between(1, 2).count() == 1


def test_hashes_blocks_and_counts(spark):
    h = make(spark, t.Hash, (1, "aa"), (2, "bb"))
    assert h.find("bb").first().id == 2 and {r.digest: r.id for r in h.probe(spark.createDataFrame([("aa",), ("cc",)], "digest string")).collect()} == {"aa": 1, "cc": None}
    assert h.remove_by_ids(ids(spark, 1)).get_count().first().cnt == 1
    b = t.BlockParts(spark.createDataFrame([(n, bytearray(b"x")) for n in range(10)], "hash_id long, data binary"), 4)
    assert b.get(7).first().hash_id == 7 and b.insert((11, bytearray(b"y"))).get_part(3).count() == 3
    c = make(spark, t.HashCount, (1, 1)).inc(1, 2).dec(2)
    assert {r.hash_id: r.cnt for r in c.counts().collect()} == {1: 2, 2: 0} and c.count_unused_hashes().first().cnt == 1
    o = make(spark, t.HashOwner, (1, "u")).add_hash_owner(spark.createDataFrame([(1, "u"), (1, "v")], "hash_id long, uuid string"))
    assert o.rows.count() == 2 and o.hash_has_owner(1, "v").count() == 1
    ct = make(spark, t.CompressionType, (1, "zstd"))
    assert ct.get_all().first().types == {1: "zstd"} and ct.get_all_revert().first().types == {"zstd": 1} and ct.find("zstd").first().id == 1
    s = make(spark, t.HashSizes, (1, 10, 5), (2, 10, 8))
    assert s.get_median_compressed_size().first()[0] == 6.5 and s.upsert(spark.createDataFrame([(2, 9, 9)], s.rows.schema)).get(2).first().compressed_size == 9


def test_catalog_on_disk(spark, tmp_path):
    c = Catalog(spark, EngineConfig(block_size=4096, partitions=3, base_path=str(tmp_path / "base"), cluster_path=str(tmp_path / "shared"))).create()
    again = Catalog(spark, EngineConfig(block_size=512, base_path=str(tmp_path / "base"))).create()
    assert (again.config.block_size, again.config.partitions) == (4096, 3)
    assert c.table("tree").rows.count() == 0
    c.write("block", spark.createDataFrame([(n, bytearray(b"x" * n)) for n in range(9)], "hash_id long, data binary"))
    assert c.exists("block") and str(tmp_path / "shared") in c.path("block")
    assert c.table("block").get(5).first().data == b"xxxxx"
    c.write("tree", make(spark, t.Tree, (1, 1, None, 0, 1), (2, 1, None, 0, 1)))
    own = c.table("tree")
    c.write("tree", own.remove_by_ids(ids(spark, 2), "subvol_id"), compression="zstd")
    assert c.table("tree").rows.count() == 1 and c.size("tree") > 0
    c.vacuum("tree")
    c.clean("tree")
    assert c.table("tree").rows.count() == 0
    c.drop("tree")
    assert not c.exists("tree")


def test_lookup_reaches_the_scan(spark, tmp_path):
    make(spark, t.Hash, *[(n, str(n)) for n in range(100)]).rows.write.parquet(str(tmp_path / "h"))
    plan = t.Hash(spark.read.parquet(str(tmp_path / "h"))).find("5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value), EqualTo(value,5)]" in plan
    b = t.BlockParts(spark.range(100).select(F.col("id").alias("hash_id"), F.lit(bytearray(b"x")).alias("data")), 4)
    b.write(str(tmp_path / "b"))
    plan = t.BlockParts(spark.read.parquet(str(tmp_path / "b")), 4).get(6)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "= 2)]" in plan
