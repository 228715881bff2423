"""Writes at an offset, paths of deep trees, folders that aren't empty, the catalog's switch, trimming."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.functions import binary
from cairn.operators import blocks, namespace, snapshots
from cairn.operators.tables import SCHEMAS
from cairn.sources.catalog import Catalog
from cairn.sources.shared import scratch


def test_trim_is_linear(spark):
    rows = [b"", b"\0", b"\0\0a", b"a\0b\0\0", bytes(range(256)), b"\xff\xfe\0", b"\0" * (1 << 24) + b"\x01", b"\x01" + b"\0" * (1 << 24)]
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(rows)], "i int, d binary").coalesce(1)
    start = time.monotonic()
    got = {r.i: r.t for r in frame.select("i", binary.trim_zeros(F.col("d")).alias("t")).collect()}
    assert time.monotonic() - start < 20
    assert all(bytes(got[i]) == x.rstrip(b"\0") for i, x in enumerate(rows))
    padded = frame.filter("i < 6").select("i", binary.pad_zeros(F.col("d"), F.lit(7)).alias("t")).collect()
    assert all(bytes(r.t) == rows[r.i].ljust(7, b"\0") for r in padded)


def test_writes_at_an_offset(spark):
    r = random.Random(3)
    size, files = 16, {i: bytes(r.randrange(256) for _ in range(r.randrange(0, 60))) for i in range(6)}
    now = {i: bytearray(x) for i, x in files.items()}
    writes = []
    for seq in range(40):
        i, offset, data = r.randrange(8), r.randrange(80), bytes(r.randrange(256) for _ in range(r.randrange(0, 40)))
        writes.append((i, seq, offset, bytearray(data)))
        if data:
            own = now.setdefault(i, bytearray())
            own.extend(b"\0" * (offset - len(own)))
            own[offset : offset + len(data)] = data
    stored = spark.createDataFrame([(i, n // size, bytearray(x[n : n + size])) for i, x in files.items() for n in range(0, len(x), size)], "inode_id long, block_number long, data binary")
    changed = blocks.merged_writes(stored, spark.createDataFrame(writes, "inode_id long, seq long, offset long, data binary"), size)
    index = stored.select("inode_id", "block_number", binary.digest(binary.trim_zeros(F.col("data"))).alias("digest"), F.octet_length("data").cast("long").alias("real_size"))
    rows, new = blocks.rewritten(index, changed)
    bytes_of = {x.digest: bytes(x.stored) for x in new.collect()} | {x.digest: bytes(x.d) for x in stored.select(binary.digest(binary.trim_zeros(F.col("data"))).alias("digest"), binary.trim_zeros(F.col("data")).alias("d")).collect()}
    got = {}
    for x in rows.collect():
        got[x.inode_id, x.block_number] = bytes_of[x.digest]
    for i, x in now.items():
        for n in range(0, len(x), size):
            assert got.pop((i, n // size), b"").rstrip(b"\0") == bytes(x[n : n + size]).rstrip(b"\0")
    assert not got


def test_paths_of_a_deep_tree(spark):
    rows = [(i, i - 1 if i % 200 else None, i) for i in range(4000)] + [(9001, 9002, 1), (9002, 9001, 2), (9003, 12345, 3)]  # a ring, an orphan
    tree = spark.createDataFrame(rows, "id long, parent_id long, name_id long")
    names = spark.range(4000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("value"))
    got = {x.id: (x.path, x.depth) for x in namespace.paths(tree, names).collect()}
    assert len(got) == 4000 and got[0] == ("n0", 0) and got[399][1] == 199 and got[399][0] == "/".join(f"n{i}" for i in range(200, 400))
    assert namespace.paths(tree, names, depth=10).count() == 20 * 11
    assert namespace.paths(tree.limit(0), names).count() == 0


def test_a_folder_that_is_not_empty_stays(spark):
    tree = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3), (4, 1, 4), (5, 1, 5)], "id long, parent_id long, inode_id long")
    inodes = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id long, nlinks long")
    events = [(1, "rmdir", 2, None), (2, "unlink", 3, None), (3, "rmdir", 2, None), (4, "create", 6, 4), (5, "rmdir", 4, None), (6, "rename", 6, 5), (7, "rmdir", 4, None), (8, "rmdir", 5, None)]
    frame = spark.createDataFrame(events, "seq long, op string, node_id long, parent_id long")
    assert sorted((x.seq, x.node_id) for x in namespace.refused(tree, inodes, frame).collect()) == [(1, 2), (5, 4), (8, 5)]


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    c = Catalog(spark, EngineConfig(base_path=str(tmp_path))).create()
    hashes = lambda n: spark.createDataFrame([(i, str(i)) for i in range(n)], SCHEMAS["hash"])
    sizes = lambda n: spark.createDataFrame([(i, 1, 1) for i in range(n)], SCHEMAS["hash_sizes"])
    c.write_all({"hash": hashes(3), "hash_sizes": sizes(3)})
    broken = sizes(5).withColumn("writed_size", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        c.write_all({"hash": hashes(5), "hash_sizes": broken})
    assert c.table("hash").rows.count() == c.table("hash_sizes").rows.count() == 3
    c.write("hash", hashes(2), "append")
    assert c.table("hash").rows.count() == 5


def test_freed_bytes(spark):
    index = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (3, 13)], "subvol_id long, hash_id long")
    sizes = spark.createDataFrame([(h, 100 + h, h) for h in range(10, 14)], "hash_id long, writed_size long, compressed_size long")
    gone = lambda *ids: tuple(snapshots.freed(index, spark.createDataFrame([(i,) for i in ids], "subvol_id long"), sizes).first())
    assert gone(3) == (1, 113, 13) and gone(2, 3) == (2, 225, 25) and gone(9) == (0, 0, 0)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(Session(), "x")
