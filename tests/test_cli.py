import hashlib

from pyspark.sql import functions as F

from cairn.cli import run
from cairn.config import EngineConfig
from cairn.operators.tables import SCHEMAS
from cairn.sources.catalog import Catalog


def test_a_store_from_making_to_cleaning(spark, tmp_path):
    base = str(tmp_path / "store")
    go = lambda *a: run(spark, [*a, "--data", base, "--now", "2024-03-15T12:00:00"])
    go("create")
    go("create-subvol", "@root")
    go("create-subvol", "work")
    c = Catalog(spark, EngineConfig(base_path=base))
    data = {1: b"A" * 900, 2: b"B" * 700, 3: b"gone"}
    frame = lambda name, rows, schema=None: c.write(name, spark.createDataFrame(rows, schema or SCHEMAS[name]))
    frame("hash", [(i, hashlib.md5(x).hexdigest()) for i, x in data.items()])
    frame("block", [(i, bytearray(x)) for i, x in data.items()], "hash_id long, data binary")
    frame("hash_sizes", [(i, len(x), len(x)) for i, x in data.items()])
    frame("compression_type", [(1, "none")])
    frame("hash_compression_type", [(i, 1) for i in data])
    frame("hash_owner", [(i, "node") for i in data])
    frame("name", [(0, "", bytearray(b"/")), (7, "", bytearray(b"f")), (8, "", bytearray(b"old"))])
    tree = c.table("tree").insert((2, 20, 1, 7, 20))
    c.write("tree", tree)
    c.write("inode", c.table("inode").insert((2, 20, 1, 0o100644, 0, 0, 0, 1600, 0, 0, 0)))
    frame("inode_hash_block", [(2, 20, 0, 1, 900), (2, 20, 1, 2, 700)])
    assert [r.name for r in go("list-subvol").collect()] == ["@root", "work"]
    go("create-snapshot", "work", "snap")
    usage = {r.subvol_id: r.data_size for r in go("subvol-stats").collect()}
    assert usage == {2: 1600, 3: 1600}
    assert {r.subvol_id: r.diff_blocks for r in go("subvol-diff").collect()} == {2: 2, 3: 2}
    assert go("print-stats").first().data_size == 3200
    assert go("created-today") == 2 and go("count-older-than", "2024-03-15T12:00:01") == 2
    assert tuple(go("verify").first()) == (3, 3)
    go("recompress", "--compress", "zstd:3")
    assert tuple(go("verify").first()) == (3, 3)
    assert c.table("hash_sizes").get(1).first().compressed_size < 900
    go("rehash", "--hash", "sha256")
    assert tuple(go("verify").first()) == (3, 3)
    counts = go("defragment")
    assert counts["block"] == counts["hash"] == counts["hash_sizes"] == 1 and counts["name"] == 1 and counts["inode"] == 0
    go("set-readonly", "work")
    assert c.table("subvolume").rows.filter("readonly").count() == 2
    assert set(go("vacuum")) >= {"block", "tree"}
    assert go("remove-by-plan", "1y") == 0 and go("remove-snapshot", "snap") == 1
    assert c.table("tree").rows.filter(F.col("subvol_id") == 3).count() == 0
