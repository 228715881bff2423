"""Hand-computed cases."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.config import EngineConfig, parse_codec
from cairn.functions import access, binary, text
from cairn.operators import blocks, codecs, gc, integrity, namespace, snapshots, usage


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, bytes) else F.lit(bytearray(v)).alias(k) for k, v in columns.items()])


FILES = [("@root", 1, b"AAAABBBB"), ("@root", 2, b"AAAACC\0\0"), ("@root", 3, b""), ("s1", 4, b"AAAADDDD"), ("s1", 5, b"\0\0\0\0")]


def stored(spark):
    rows = spark.createDataFrame([(s, i, bytearray(x)) for s, i, x in FILES], "subvol string, inode_id long, data binary")
    return blocks.cut(rows, 4), spark.createDataFrame([(s, i, len(x)) for s, i, x in FILES], "subvol string, id long, size long")


def test_cut_trims_zeros_and_keeps_sizes(spark):
    cut, _ = stored(spark)
    got = {(r.inode_id, r.block_number): (r.real_size, bytes(r.stored), r.writed_size, r.digest) for r in cut.collect()}
    want = {(1, 0): b"AAAA", (1, 1): b"BBBB", (2, 0): b"AAAA", (2, 1): b"CC", (4, 0): b"AAAA", (4, 1): b"DDDD", (5, 0): b""}
    assert got == {k: (4, v, len(v), hashlib.md5(v).hexdigest()) for k, v in want.items()}


def test_usage_and_root_difference(spark):
    cut, inodes = stored(spark)
    index = cut.select("subvol", "inode_id", "block_number", F.col("digest").alias("hash_id"), "real_size")
    sizes = cut.select(F.col("digest").alias("hash_id"), "writed_size", F.col("writed_size").alias("compressed_size")).distinct()
    got = {r.subvol: (r.apparent_size, r.data_size, r.unique_size, r.dedup_size, r.sparse_size) for r in usage.usage(index, inodes, sizes).collect()}
    assert got == {"@root": (16, 14, 10, 4, 2), "s1": (12, 8, 8, 0, 4)}
    diff = {r.subvol: (r.diff_blocks, r.diff_real_size) for r in usage.root_diff(index, "@root").collect()}
    assert diff == {"@root": (0, 0), "s1": (2, 8)}
    refs = sorted(r.refs for r in usage.refcounts(index).collect())
    assert refs == [1, 1, 1, 1, 3]


def test_retention(spark):
    days = ["2024-03-15 01:00", "2024-03-15 09:00", "2024-03-14 09:00", "2024-03-10 09:00", "2024-03-05 09:00", "2024-03-01 09:00", "2024-02-20 09:00", "2024-02-02 09:00", "2024-01-07 09:00", "2023-12-31 09:00"]
    rows = spark.createDataFrame([(x,) for x in days], "t string").select(F.to_timestamp("t", "yyyy-MM-dd HH:mm").alias("at"))
    plan = snapshots.Plan.parse("2d,2w,2m,1y")
    say = lambda df: sorted(r.at.strftime("%Y-%m-%d %H:%M") for r in df.collect())
    gone = {"2024-03-15 01:00", "2024-02-20 09:00", "2023-12-31 09:00"}
    assert say(snapshots.retained(rows, "at", "2024-03-15 12:00:00", plan)) == sorted(set(days) - gone)
    assert say(snapshots.removed(rows, "at", "2024-03-15 12:00:00", plan)) == sorted(gone)


def test_retention_day_by_day(spark):
    """Each day's kept snapshots are the next day's: the plan holds as many as its bins at most."""
    kept, plan, start = [], snapshots.Plan(3, 2, 2, 1), dt.datetime(2023, 11, 20, 6)
    for n in range(0, 60, 6):
        day = start + dt.timedelta(days=n)
        rows = spark.createDataFrame([(x,) for x in [*kept, day]], "at timestamp")
        kept = [r.at for r in snapshots.retained(rows, "at", day.strftime("%Y-%m-%d %H:%M:%S"), plan).collect()]
        assert day in kept and len(kept) <= 8


@pytest.mark.parametrize(("said", "plan"), [("14d,8w,6m,2y", (14, 8, 6, 2)), ("14days", (14, 0, 0, 0)), ("2y 1w", (0, 1, 0, 2))])
def test_plan_parser(said, plan):
    p = snapshots.Plan.parse(said)
    assert (p.daily, p.weekly, p.monthly, p.yearly) == plan


def test_truncation_keeps_one_block_more_unless_strict(spark):
    index = spark.createDataFrame([(1, n) for n in range(4)], "inode_id long, block_number long")
    bounds = spark.createDataFrame([(1, 8)], "inode_id long, size long")
    say = lambda **k: sorted(r.block_number for r in blocks.truncated(index, bounds, "inode_id", "block_number", 4, **k).collect())
    assert say() == [0, 1, 2] and say(strict=True) == [0, 1]


def test_reference_counts_of_overwritten_blocks(spark):
    log = spark.createDataFrame([(1, 0, 1, "A"), (1, 0, 2, "B"), (1, 0, 3, "A")], "inode_id long, block_number long, seq long, hash_id string")
    index = blocks.last_write(log, ["inode_id", "block_number"], ["seq"])
    assert [r.hash_id for r in index.collect()] == ["A"]
    assert {r.hash_id: (r.write_refs, r.live_refs) for r in usage.write_refcounts(log, index).collect()} == {"A": (2, 1), "B": (1, 0)}
    combined = blocks.last_write(log, ["inode_id", "block_number"], ["seq"], combine=True)
    assert [r.hash_id for r in combined.collect()] == ["A"]


def test_median_and_mean(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "compressed_size long")
    assert tuple(usage.typical_sizes(rows).first()) == (2.5, 4.0, 512)
    assert tuple(usage.typical_sizes(rows.limit(0)).first()) == (0.0, 0.0, 512)


@pytest.mark.parametrize(("n", "label"), [(0, "0 bytes"), (1023, "1023 bytes"), (1024, "1 KiB"), (1536, "1.50 KiB"), (1 << 20, "1 MiB"), (3 << 40, "3 TiB")])
def test_format_size(spark, n, label):
    assert one(spark, n=n).select(text.format_size(F.col("n").cast("long"))).first()[0] == label


@pytest.mark.parametrize(("n", "label"), [(0, "less than a second"), (1, "1 second"), (61, "1 minute and 1 second"), (93603, "1 day, 2 hours and 3 seconds"), (3600, "1 hour")])
def test_format_timespan(spark, n, label):
    assert one(spark, n=n).select(text.format_timespan(F.col("n"))).first()[0] == label


@pytest.mark.parametrize(("uid", "gid", "rwx"), [(1, 1, (True, True, False)), (3, 2, (True, False, False)), (3, 3, (False, False, False)), (9, 0, (True, True, True))])
def test_access(spark, uid, gid, rwx):
    row = one(spark, mode=0o640, o=1, g=2, uid=uid, gid=gid)
    got = row.select(*[access.allowed(F.col("mode"), F.col("o"), F.col("g"), F.col("uid"), F.col("gid"), w).alias(str(w)) for w in (4, 2, 1)]).first()
    assert tuple(got) == rwx


def test_block_round_trip(spark):
    """Cut, deduplicate, put together again: the same bytes, holes included."""
    r = random.Random(3)
    data = {i: bytes(r.choice(b"ab\0") for _ in range(r.choice([0, 1, 4, 9, 40]))) for i in range(60)}
    files = spark.createDataFrame([(i, bytearray(x)) for i, x in data.items()], "inode_id long, data binary")
    index = blocks.cut(files, 4)
    once = blocks.first_occurrence(index.select("digest", "inode_id", "block_number", "stored"), ["inode_id", "block_number"]).select("digest", "stored")
    assert once.count() < index.count() and blocks.collisions(index).count() == 0
    rows = index.drop("stored").join(once, "digest").withColumn("seen", binary.pad_zeros(F.col("stored"), F.col("real_size")))
    sizes = spark.createDataFrame([(i, len(x)) for i, x in data.items()], "inode_id long, size long")
    rows = rows.join(sizes, "inode_id")
    for offset, size in ((0, 1000), (3, 6), (8, 1)):
        got = {x.inode_id: bytes(x.data) for x in blocks.read_range(rows, "inode_id", "block_number", "seen", 4, F.lit(offset), F.lit(size), F.col("size")).collect()}
        assert {i: x for i, x in got.items() if x} == {i: x[offset : offset + size] for i, x in data.items() if x[offset : offset + size]}


def test_write_spans(spark):
    w = spark.createDataFrame([(1, 3, bytearray(b"abcdef")), (2, 0, bytearray(b""))], "inode_id long, offset long, data binary")
    got = sorted((r.block_number, r.start, bytes(r.data)) for r in blocks.write_spans(w, 4).collect())
    assert got == [(0, 3, b"a"), (1, 0, b"bcde"), (2, 0, b"f")]


@pytest.mark.parametrize("name", [c for c in codecs.CODECS])
def test_codec_round_trip(name):
    r = random.Random(1)
    for x in (b"a", b"abc" * 100, bytes(r.randrange(65, 91) for _ in range(4096)), bytes(5000)):
        for level in (None, "fast", "best", 99, -200):
            assert codecs.decompress(name, codecs.compress(name, x, level)) == x


def test_lz4h_is_lz4_by_high_compression():
    r = random.Random(3)
    x = b" ".join(r.choice([b"block", b"hash", b"inode", b"tree", b"name"]) + bytes([r.randrange(97, 123)]) for _ in range(4000))
    made = codecs.compress("lz4h", x)
    assert len(made) < len(codecs.compress("lz4", x)) and codecs.decompress("lz4", made) == x
    assert codecs.pack(x, EngineConfig(codecs=("lz4", "lz4h")))[0] == "lz4h" and ("lz4h", "default") in codecs.chosen(("all",))


def test_best_codec_and_guards(spark):
    c = EngineConfig(codecs=("zlib:9", "lz4", "none"), minimal_size=64, minimal_ratio=0.05)
    assert codecs.pack(b"", c) == ("none", b"") and codecs.pack(b"a" * 64, c)[0] == "none"
    assert codecs.pack(b"a" * 65, c)[0] in ("zlib", "lz4")
    noise = random.Random(2).randbytes(1000)
    assert codecs.pack(noise, c) == ("none", noise) and codecs.pack(noise, EngineConfig(codecs=("zlib",), forced=True)) == ("none", noise)
    assert codecs.pack(b"a" * 20, EngineConfig(codecs=("zlib",), forced=True))[0] == "zlib"
    rows = spark.createDataFrame([("h", "none", bytearray(b"xy" * 500)), ("g", "zlib", bytearray(codecs.compress("zlib", b"q" * 900)))], "digest string, codec string, data binary")
    assert [r.codec for r in integrity.to_recompress(rows, EngineConfig(codecs=("zstd",))).collect()] == ["zlib"]
    out = {r.digest: r for r in integrity.recompress(rows, EngineConfig(codecs=("zstd:3",))).collect()}
    assert {r.codec for r in out.values()} == {"zstd"} and all(len(r.data) == r.compressed_size < r.writed_size for r in out.values())
    assert codecs.chosen(("all_fast",))[0] == ("brotli", "fast") and parse_codec("zstd:-5") == ("zstd", -5)


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha512", "sha3_256", "blake2b"])
def test_digests_and_verification(spark, name):
    rows = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b""),)], "data binary").withColumn("digest", binary.digest(F.col("data"), name))
    assert {r.digest for r in rows.collect()} == {hashlib.new(name, x).hexdigest() for x in (b"abc", b"")}
    assert tuple(integrity.verified_counts(integrity.verify(rows, name, codec=None)).first()) == (2, 2)


def test_garbage_collection_is_idempotent(spark):
    f = spark.createDataFrame
    t = {
        "tree": f([(1, None, 10, 1), (2, 1, 11, 2)], "id long, parent_id long, name_id long, inode_id long"),
        "name": f([(10, "a"), (11, "b"), (12, "c")], "id long, value string"),
        "inode": f([(1, 0), (2, 8), (3, 4)], "id long, size long"),
        "xattr": f([(2,), (3,)], "inode_id long"),
        "link": f([(3,)], "inode_id long"),
        "inode_hash_block": f([(2, 0, 100), (2, 1, 101), (2, 2, 102), (2, 3, 103), (3, 0, 104)], "inode_id long, block_number long, hash_id long"),
        "hash_sizes": f([(h,) for h in range(100, 106)], "hash_id long"),
        "hash_owner": f([(h, "x") for h in range(100, 106)], "hash_id long, uuid string"),
    }
    once = gc.collect(t, 4)
    assert {k: v.count() for k, v in once.items()} == {"tree": 2, "name": 2, "inode": 2, "xattr": 1, "link": 0, "inode_hash_block": 3, "hash_sizes": 3, "hash_owner": 3}
    again = gc.collect(once, 4)
    assert {k: v.count() for k, v in again.items()} == {k: v.count() for k, v in once.items()}


def test_events_change_the_tree(spark):
    tree = spark.createDataFrame([(1, None, 0, 1), (2, 1, 10, 2), (3, 1, 11, 3)], "id long, parent_id long, name_id long, inode_id long")
    inodes = spark.createDataFrame([(1, 2, 0o040755), (2, 1, 0o100644), (3, 1, 0o100644)], "id long, nlinks long, mode long")
    log = [(1, "create", 4, 1, 12, 4, 0o100600), (2, "mkdir", 5, 1, 13, 5, 0o040755), (3, "link", 6, 5, 14, 2, None), (4, "rename", 3, 1, 10, None, None), (5, "unlink", 4, None, None, None, None)]
    events = spark.createDataFrame(log, "seq long, op string, node_id long, parent_id long, name_id long, inode_id long, mode long")
    now, counted = namespace.apply_events(tree, inodes, events)
    assert {(r.id, r.parent_id, r.name_id, r.inode_id) for r in now.collect()} == {(1, None, 0, 1), (3, 1, 10, 3), (5, 1, 13, 5), (6, 5, 14, 2)}
    assert {r.id: r.nlinks for r in counted.collect()} == {1: 3, 2: 1, 3: 1, 4: 0, 5: 2}
    assert {r.parent_id for r in namespace.occupied(now, counted).collect()} == {1, 5, None}


def test_setattr_takes_the_last_value_of_each_column(spark):
    inodes = spark.createDataFrame([(1, 100, 0o644), (2, 5, 0o600)], "id long, size long, mode long")
    changes = spark.createDataFrame([(1, 1, 50, None), (2, 1, None, 0o600), (3, 1, 40, None)], "seq long, id long, size long, mode long")
    got = {r.id: (r.size, r.mode, r.truncated) for r in namespace.apply_setattr(inodes, changes).collect()}
    assert got == {1: (40, 0o600, True), 2: (5, 0o600, False)}


def test_xattr_maps(spark):
    rows = spark.sql("select 1 as inode_id, map('a', 'x', 'b', 'y') as attrs")
    out = rows.select(namespace.xattr_set(F.col("attrs"), "a", F.lit("z")).alias("s"), namespace.xattr_remove(F.col("attrs"), "a").alias("r")).first()
    assert out.s == {"a": "z", "b": "y"} and out.r == {"b": "y"}


def test_snapshot_algebra(spark):
    now = dt.datetime(2024, 3, 15, 12)
    subs = spark.createDataFrame([(1, hashlib.md5(b"@root").hexdigest(), "@root", False, now, now, now)], "id long, hash string, name string, readonly boolean, created_at timestamp, mounted_at timestamp, updated_at timestamp")
    inodes = spark.createDataFrame([], "subvol_id long, id long, nlinks long, mode long, uid long, gid long, rdev long, size long, atime_ns long, mtime_ns long, ctime_ns long")
    tree = spark.createDataFrame([(1, 1, None, 0, 1)], "subvol_id long, id long, parent_id long, name_id long, inode_id long")
    subs, inodes, tree = snapshots.create(subs, inodes, tree, 2, "work", now)
    again = snapshots.create(subs, inodes, tree, 3, "work", now)
    assert subs.count() == again[0].count() == 2 and inodes.first().nlinks == 2
    subs, tables = snapshots.make(subs, {"tree": tree, "inode": inodes}, "work", "snap", 3, now)
    assert {r.name: r.readonly for r in subs.collect()}["snap"] is True and tables["tree"].filter("subvol_id = 3").count() == 1
    assert {r.name for r in snapshots.older_than(subs, "2024-03-16T00:00:00").collect()} == {"work", "snap"}
    assert snapshots.created_on(subs, "2024-03-15").first()[0] == 2 and snapshots.created_on(subs, "2024-03-15", True).first()[0] == 1
    subs, tables = snapshots.remove(subs, tables, "snap")
    assert subs.count() == 2 and tables["tree"].filter("subvol_id = 3").count() == 0
