"""The store's tables as immutable values: each operation takes rows and gives a DataFrame or a new table.

Point lookups are filters that reach the Parquet scan; id sets are DataFrames and join by left_semi or left_anti, never literal lists; changes
are appends, anti-joins and conditional columns. Ids are given by the caller or are digests, so that no global counter is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed schemas of the logical tables.
SCHEMAS = {
    "option": "name string, value string",
    "subvolume": "id long, hash string, name string, readonly boolean, stats string, root_diff string, stats_at timestamp, root_diff_at timestamp, created_at timestamp, mounted_at timestamp, updated_at timestamp",
    "name": "id long, hash string, value binary",
    "tree": "subvol_id long, id long, parent_id long, name_id long, inode_id long",
    "inode": "subvol_id long, id long, nlinks long, mode long, uid long, gid long, rdev long, size long, atime_ns long, mtime_ns long, ctime_ns long",
    "link": "subvol_id long, inode_id long, target binary",
    "xattr": "subvol_id long, inode_id long, attrs map<string,binary>",
    "inode_hash_block": "subvol_id long, inode_id long, block_number long, hash_id long, real_size long",
    "inode_option": "inode long, block_size int, compression string",
    "name_pattern_option": "pattern string, block_size int, compression string",
    "hash": "id long, value string",
    "block": "hash_id long, data binary",
    "hash_sizes": "hash_id long, writed_size long, compressed_size long",
    "hash_compression_type": "hash_id long, type_id long",
    "compression_type": "id long, value string",
    "hash_count": "hash_id long, delta long",
    "hash_owner": "hash_id long, uuid string",
    "tmp_ids": "id long",
    "tmp_id_count": "id long, delta long",
}
#: Bytes a row counts for in a folder's size (fixed values); names count 24 and twice their length.
TREE_ROW, INODE_ROW = 32, 80


class Table:
    """A DataFrame with a key. Subclasses add what is particular to a table."""

    name = ""
    key = ("id",)

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _new(self, rows: DataFrame):
        return type(self)(rows)

    def _is(self, *values) -> Column:
        out = F.lit(True)
        for column, value in zip(self.key, values, strict=True):
            out &= F.col(column) == F.lit(value)
        return out

    def insert(self, *rows: tuple):
        """Append rows given as tuples in the schema's order, or one DataFrame."""
        more = rows[0] if len(rows) == 1 and isinstance(rows[0], DataFrame) else self.rows.sparkSession.createDataFrame(list(rows), self.rows.schema)
        return self._new(self.rows.unionByName(more))

    def upsert(self, more: DataFrame):
        """Rows of `more` take the place of those with their key."""
        return self._new(self.rows.join(more.select(*self.key).distinct(), list(self.key), "left_anti").unionByName(more))

    def update(self, *key_and, **columns):
        """Set columns of the row with a key: update(key..., column=value)."""
        hit = self._is(*key_and)
        return self._new(self.rows.withColumns({c: F.when(hit, F.lit(v).cast(self.rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in columns.items()}))

    def delete(self, *key):
        return self._new(self.rows.filter(~self._is(*key)))

    def get(self, *key) -> DataFrame:
        return self.rows.filter(self._is(*key))

    def get_count(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("cnt"))

    def get_ids_between(self, start: int, end: int) -> DataFrame:
        """Ids in [start, end), by a filter that prunes row groups."""
        c = self.key[-1] if self.name not in ("link", "xattr", "inode_hash_block") else "inode_id"
        return self.rows.filter((F.col(c) >= start) & (F.col(c) < end)).select(c).distinct()

    def among(self, ids: DataFrame, column: str | None = None) -> DataFrame:
        """Rows whose id is in a set."""
        c = column or self.key[0]
        return self.rows.join(ids.select(F.col(ids.columns[0]).alias(c)), c, "left_semi")

    def remove_by_ids(self, ids: DataFrame, column: str | None = None):
        """Without the rows whose id is in a set."""
        c = column or self.key[0]
        return self._new(self.rows.join(ids.select(F.col(ids.columns[0]).alias(c)), c, "left_anti"))


class Option(Table):
    name, key = "option", ("name",)

    def get_all(self) -> DataFrame:
        return self.rows.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("options"))


class Subvolume(Table):
    name = "subvolume"

    def insert_named(self, id: int, name: str, created_at, **more):
        row = {"id": id, "hash": None, "name": name, "readonly": False, "created_at": created_at} | more
        rows = self.rows.sparkSession.createDataFrame([tuple(row.get(c) for c in self.rows.columns)], self.rows.schema)
        return self.insert(rows.withColumn("hash", F.md5(F.col("name").cast("binary"))))

    def readonly(self, id: int, flag: bool = True):
        return self.update(id, readonly=flag)

    def _stamp(self, id: int, column: str, at=None):
        hit = self._is(id)
        return self._new(self.rows.withColumn(column, F.when(hit, F.lit(at).cast("timestamp") if at is not None else F.current_timestamp()).otherwise(F.col(column))))

    def mount_time(self, id: int, at=None):
        return self._stamp(id, "mounted_at", at)

    def update_time(self, id: int, at=None):
        return self._stamp(id, "updated_at", at)

    def stats_time(self, id: int, at=None):
        return self._stamp(id, "stats_at", at)

    def root_diff_time(self, id: int, at=None):
        return self._stamp(id, "root_diff_at", at)

    def set_stats(self, id: int, stats: str):
        return self.update(id, stats=stats)

    def set_root_diff(self, id: int, diff: str):
        return self.update(id, root_diff=diff)

    def find(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("hash") == F.md5(F.lit(name).cast("binary")))

    def get_ids(self, order_by: str | None = None, descending: bool = False) -> DataFrame:
        ids = self.rows.select("id", *([order_by] if order_by and order_by != "id" else []))
        return (ids.orderBy(F.desc(order_by) if descending else F.asc(order_by)) if order_by else ids).select("id")

    def fresh(self, made_at: str = "stats_at") -> DataFrame:
        """Rows whose cached figures are not older than the subvolume."""
        return self.rows.filter(F.col("updated_at") <= F.col(made_at))


class Name(Table):
    name = "name"

    def find(self, value: str) -> DataFrame:
        return self.rows.filter(F.col("hash") == F.md5(F.lit(value).cast("binary"))).select("id")

    def find_all(self, values: DataFrame, column: str) -> DataFrame:
        """The ids of many values, by their digest."""
        return values.withColumn("hash", F.md5(F.col(column).cast("binary"))).join(self.rows.select("id", "hash"), "hash", "left")

    def row_sizes(self) -> DataFrame:
        return self.rows.select("id", (F.lit(24) + 2 * F.octet_length("value")).cast("long").alias("row_size"))


class Tree(Table):
    name = "tree"

    def rename(self, node: int, parent: int, name: int):
        return self.update(node, parent_id=parent, name_id=name)

    def find_by_parent_name(self, parent: int, name: int) -> DataFrame:
        return self.rows.filter((F.col("parent_id") == parent) & (F.col("name_id") == name))

    def find_by_inode(self, inode: int) -> DataFrame:
        """The first node of an inode, by id."""
        return self.rows.filter(F.col("inode_id") == inode).agg(F.min("id").alias("id")).filter("id is not null")

    def get_children(self, parent: int, after: int = 0, limit: int | None = None) -> DataFrame:
        """Children in order of id beyond a node: a page by key, not by offset."""
        out = self.rows.filter((F.col("parent_id") == parent) & (F.col("id") > after)).orderBy("id")
        return out.limit(limit) if limit else out

    def get_children_inodes(self, parent: int) -> DataFrame:
        return self.get_children(parent).select("inode_id")

    def get_inodes_by_inodes(self, inodes: DataFrame) -> DataFrame:
        return self.among(inodes, "inode_id").select("inode_id").distinct()

    def get_all_inodes(self) -> DataFrame:
        return self.rows.select("inode_id").distinct()


class Inode(Table):
    name = "inode"

    def get_mode(self, id: int) -> DataFrame:
        return self.get(id).select("mode")

    def get_size(self, id: int) -> DataFrame:
        return self.get(id).select("size")

    def update_data(self, id: int, **columns):
        return self.update(id, **columns)

    def add_links(self, deltas: DataFrame):
        """deltas (id, delta): many links and unlinks at once."""
        d = deltas.groupBy("id").agg(F.sum("delta").alias("_d"))
        return self._new(self.rows.join(d, "id", "left").withColumn("nlinks", F.col("nlinks") + F.coalesce("_d", F.lit(0))).select(*self.rows.columns))

    def inc_nlinks(self, id: int):
        return self._new(self.rows.withColumn("nlinks", F.when(self._is(id), F.col("nlinks") + 1).otherwise(F.col("nlinks"))))

    def dec_nlinks(self, id: int):
        return self._new(self.rows.withColumn("nlinks", F.when(self._is(id), F.col("nlinks") - 1).otherwise(F.col("nlinks"))))

    def count_nlinks_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.among(ids).filter("nlinks <> 0").agg(F.count(F.lit(1)).alias("cnt"))

    def get_sizes(self) -> DataFrame:
        return self.rows.filter("nlinks > 0").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"))

    def get_sizes_by_id(self, ids: DataFrame) -> DataFrame:
        return self.among(ids).select("id", "size")

    def get_sizes_by_inodes(self, ids: DataFrame) -> DataFrame:
        return self._new(self.among(ids)).get_sizes()

    def get_inodes_by_inodes(self, ids: DataFrame) -> DataFrame:
        return self.among(ids).select("id")


class Link(Table):
    name, key = "link", ("inode_id",)

    def find_by_inode(self, inode: int) -> DataFrame:
        return self.get(inode).select("target")


class Xattr(Table):
    name, key = "xattr", ("inode_id",)

    def find(self, inode: int) -> DataFrame:
        return self.get(inode).select("attrs")


class InodeHashBlock(Table):
    name, key = "inode_hash_block", ("inode_id", "block_number")

    def update_hash(self, inode: int, number: int, hash_id: int):
        return self.update(inode, number, hash_id=hash_id)

    def update_size(self, inode: int, number: int, size: int):
        return self.update(inode, number, real_size=size)

    def delete_inode(self, inode: int):
        return self._new(self.rows.filter(F.col("inode_id") != inode))

    def delete_by_inode_number(self, inode: int, number: int):
        return self.delete(inode, number)

    def delete_by_inode_number_more(self, inode: int, number: int) -> tuple:
        """The table without an inode's blocks beyond a number, and those."""
        beyond = (F.col("inode_id") == inode) & (F.col("block_number") > number)
        return self._new(self.rows.filter(~beyond)), self.rows.filter(beyond)

    def hash_by_inode_number(self, inode: int, number: int) -> DataFrame:
        return self.get(inode, number).select("hash_id")

    def get_count_uniq_inodes(self) -> DataFrame:
        return self.rows.agg(F.count_distinct("inode_id").alias("cnt"))

    def get_uniq_hashes(self) -> DataFrame:
        return self.rows.select("hash_id").distinct()

    def count_hashes_by_hashes(self, hashes: DataFrame) -> DataFrame:
        return self.among(hashes, "hash_id").agg(F.count(F.lit(1)).alias("cnt"))

    def count_realsize_by_hashes(self, hashes: DataFrame) -> DataFrame:
        return self.among(hashes, "hash_id").agg(F.coalesce(F.sum("real_size"), F.lit(0)).alias("size"))

    def remove_by_inodes(self, inodes: DataFrame):
        return self.remove_by_ids(inodes, "inode_id")

    def get_hashid_by_inodes(self, inodes: DataFrame) -> DataFrame:
        return self.among(inodes, "inode_id").select("hash_id")

    def get_hash_inode_ids(self) -> DataFrame:
        return self.rows.select("hash_id", "inode_id")


class _Override(Table):
    def update_compression(self, key, compression: str):
        return self.update(key, compression=compression)

    def update_block_size(self, key, block_size: int):
        return self.update(key, block_size=block_size)


class InodeOption(_Override):
    name, key = "inode_option", ("inode",)


class NamePatternOption(_Override):
    name, key = "name_pattern_option", ("pattern",)

    def get_all(self) -> DataFrame:
        return self.rows

    def matching(self, names: DataFrame, column: str) -> DataFrame:
        """Names with the override of the longest glob pattern that matches them. There are few patterns, one join condition for each name."""
        like = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.\\+^$(){}|\[\]])", r"\\$1"), r"\*", ".*"), r"\?", ".")
        patterns = self.rows.withColumn("_like", F.concat(F.lit("^"), like, F.lit("$")))
        hit = names.join(patterns, F.regexp(names[column], F.col("_like")), "left")
        best = F.max_by(F.struct("pattern", "block_size", "compression"), F.struct(F.length("pattern"), F.col("pattern"))).alias("_b")
        return hit.groupBy(*names.columns).agg(best).select(*names.columns, "_b.*")


class Hash(Table):
    name = "hash"

    def find(self, digest: str) -> DataFrame:
        return self.rows.filter(F.col("value") == digest).select("id")

    def probe(self, digests: DataFrame, column: str = "digest") -> DataFrame:
        """The dedup probe for many digests at once: their ids, null for new ones."""
        return digests.join(self.rows.select("id", F.col("value").alias(column)), column, "left")


class Block(Table):
    name, key = "block", ("hash_id",)


class BlockParts(Block):
    """Blocks in partitions by hash id: a lookup names its partition too, so that only that one is read."""

    name = "block_parts"

    def __init__(self, rows: DataFrame, partitions: int = 1):
        super().__init__(rows if "part" in rows.columns else rows.withColumn("part", F.pmod("hash_id", F.lit(partitions)).cast("int")))
        self.partitions = partitions

    def _new(self, rows: DataFrame):
        return BlockParts(rows, self.partitions)

    def insert(self, *rows):
        more = rows[0] if len(rows) == 1 and isinstance(rows[0], DataFrame) else self.rows.sparkSession.createDataFrame(list(rows), "hash_id long, data binary")
        return super().insert(BlockParts(more, self.partitions).rows)

    def get(self, hash_id: int) -> DataFrame:
        return self.get_part(hash_id % self.partitions).filter(F.col("hash_id") == hash_id)

    def get_part(self, n: int) -> DataFrame:
        return self.rows.filter(F.col("part") == n)

    def write(self, path: str) -> None:
        self.rows.repartition("part").write.partitionBy("part").mode("overwrite").parquet(path)


class HashSizes(Table):
    name, key = "hash_sizes", ("hash_id",)

    def get_sizes_by_hash_ids(self, ids: DataFrame) -> DataFrame:
        return self.among(ids)

    def get_median_compressed_size(self) -> DataFrame:
        return self.rows.agg(F.coalesce(F.expr("percentile(compressed_size, 0.5)"), F.lit(0.0)).alias("median"))

    def get_mean_compressed_size(self) -> DataFrame:
        return self.rows.agg(F.coalesce(F.avg("compressed_size"), F.lit(0.0)).alias("mean"))


class HashCompressionType(Table):
    name, key = "hash_compression_type", ("hash_id",)

    def get_types_by_hash_ids(self, ids: DataFrame) -> DataFrame:
        return self.among(ids)


class CompressionType(Table):
    name = "compression_type"

    def find(self, value: str) -> DataFrame:
        return self.rows.filter(F.col("value") == value).select("id")

    def get_all(self) -> DataFrame:
        return self.rows.agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("types"))

    def get_all_revert(self) -> DataFrame:
        return self.rows.agg(F.map_from_entries(F.collect_list(F.struct("value", "id"))).alias("types"))


class HashCount(Table):
    """Reference counts as signed deltas: inc and dec append, reading sums."""

    name, key = "hash_count", ("hash_id",)

    def inc(self, *ids: int):
        return self.insert(*[(i, 1) for i in ids])

    def dec(self, *ids: int):
        return self.insert(*[(i, -1) for i in ids])

    def counts(self) -> DataFrame:
        return self.rows.groupBy("hash_id").agg(F.sum("delta").alias("cnt"))

    def find(self, hash_id: int) -> DataFrame:
        return self.get(hash_id).select("hash_id").limit(1)

    def get_unused_hashes(self) -> DataFrame:
        return self.counts().filter("cnt <= 0").select("hash_id")

    def count_unused_hashes(self) -> DataFrame:
        return self.get_unused_hashes().agg(F.count(F.lit(1)).alias("cnt"))


class HashOwner(Table):
    """Pairs of hash and owner; a hash may have several."""

    name, key = "hash_owner", ("hash_id", "uuid")

    def hash_has_owner(self, hash_id: int, uuid: str) -> DataFrame:
        return self.get(hash_id, uuid)

    def add_hash_owner(self, pairs: DataFrame):
        return self._new(self.rows.unionByName(pairs).distinct())


class TmpIds(Table):
    name = "tmp_ids"

    def find(self, id: int) -> DataFrame:
        return self.get(id)

    def get_ids_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.among(ids)


class TmpIdCount(HashCount):
    name, key = "tmp_id_count", ("id",)

    def counts(self) -> DataFrame:
        return self.rows.groupBy("id").agg(F.sum("delta").alias("cnt"))

    def find(self, id: int) -> DataFrame:
        return self.get(id).select("id").limit(1)


CLASSES: dict[str, type[Table]] = {c.name: c for c in (Option, Subvolume, Name, Tree, Inode, Link, Xattr, InodeHashBlock, InodeOption, NamePatternOption, Hash, Block, HashSizes, HashCompressionType, CompressionType, HashCount, HashOwner, TmpIds, TmpIdCount)}


def union_of(tables: Iterable[Table]) -> Table:
    """One table over the rows of several of a kind."""
    first, *rest = tables
    for t in rest:
        first = first.insert(t.rows)
    return first
