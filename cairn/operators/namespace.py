"""The tree of names: paths, lookups, folders in pages, attributes, and the events that change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.access import DIRECTORY, REGULAR, SYMLINK
from cairn.sources.shared import written

DEPTH = 4095


def paths(tree: DataFrame, names: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, path, depth of every node that a root (null parent) leads to, by pointer doubling: each round joins every node's path to that of the
    ancestor it has reached, so that there are as many rounds as the depth has bits. Nodes without a way to a root, or deeper than `depth`, are left out."""
    own = names.select(F.col("id").alias("name_id"), F.col("value").cast("string").alias("path"))
    now = written(tree.select("id", F.col("parent_id").alias("up"), "name_id").join(own, "name_id").select("id", "up", "path", F.lit(0).alias("depth")), "paths")
    for _ in range(depth.bit_length()):
        if not now.filter("up is not null").head(1):
            break
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        longer = now.filter("up is not null").join(above, "up").select("id", F.col("_up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"), (F.col("depth") + F.col("_depth") + 1).alias("depth"))
        now = written(now.filter("up is null").unionByName(longer), "paths")
    return now.filter(F.col("up").isNull() & (F.col("depth") <= depth)).select("id", "path", "depth")


def lookup(tree: DataFrame, names: DataFrame, inodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (parent_id, name) -> its node and inode; '.' is the parent itself, '..' the parent's parent (a root's own)."""
    by_name = wanted.filter(~F.col("name").isin(".", "..")).join(names.select(F.col("id").alias("name_id"), F.col("value").cast("string").alias("name")), "name")
    plain = by_name.join(tree.select("parent_id", "name_id", "id", "inode_id"), ["parent_id", "name_id"]).select("parent_id", "name", "id", "inode_id")
    own = wanted.filter(F.col("name") == ".").join(tree.select(F.col("id").alias("parent_id"), "inode_id"), "parent_id").select("parent_id", "name", F.col("parent_id").alias("id"), "inode_id")
    up = wanted.filter(F.col("name") == "..").join(tree.select(F.col("id").alias("parent_id"), F.coalesce("parent_id", "id").alias("id")), "parent_id")
    up = up.join(tree.select("id", "inode_id"), "id").select("parent_id", "name", "id", "inode_id")
    return getattr_rows(plain.unionByName(own).unionByName(up), inodes)


def getattr_rows(nodes: DataFrame, inodes: DataFrame, block_size: int = 512) -> DataFrame:
    """Nodes with their inode's attributes; st_blocks counts whole blocks."""
    attributes = inodes.select(F.col("id").alias("inode_id"), "nlinks", "mode", "uid", "gid", "rdev", "size", "atime_ns", "mtime_ns", "ctime_ns")
    return nodes.join(attributes, "inode_id").withColumn("st_blocks", F.floor(F.col("size") / block_size).cast("long"))


def readdir(tree: DataFrame, names: DataFrame, inodes: DataFrame, parent: int, after: int = 0, limit: int | None = None) -> DataFrame:
    """A folder's entries by node id, a page by key: those beyond a node."""
    page = tree.filter((F.col("parent_id") == parent) & (F.col("id") > after)).select("id", "name_id", "inode_id")
    if limit:
        page = page.orderBy("id").limit(limit)
    out = page.join(names.select(F.col("id").alias("name_id"), F.col("value").alias("name")), "name_id").join(inodes.select(F.col("id").alias("inode_id"), "mode", "size"), "inode_id")
    return out.select("id", "name", "inode_id", "mode", "size").orderBy("id")


def intern(values: DataFrame, column: str) -> DataFrame:
    """Distinct values under their md5, which is their key: equal names anywhere are one, without a global counter."""
    return values.select(F.md5(F.col(column).cast("binary")).alias("hash"), F.col(column).alias("value")).distinct()


def readlink(links: DataFrame, inodes: DataFrame) -> DataFrame:
    return links.join(inodes.filter(F.col("mode").bitwiseAND(0o170000) == SYMLINK).select(F.col("id").alias("inode_id")), "inode_id", "left_semi")


def xattr_get(xattrs: DataFrame, name: str) -> DataFrame:
    return xattrs.select("inode_id", F.element_at("attrs", name).alias("value")).filter("value is not null")


def xattr_list(xattrs: DataFrame) -> DataFrame:
    return xattrs.select("inode_id", F.sort_array(F.map_keys("attrs")).alias("names"))


def xattr_set(attrs: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != name), F.create_map(F.lit(name), value))


def xattr_remove(attrs: Column, name: str) -> Column:
    return F.map_filter(attrs, lambda k, v: k != name)


def new_inode(kind: str, permissions: int) -> tuple[int, int]:
    """Mode and links of a new inode: a folder has two."""
    return {"dir": (DIRECTORY | permissions, 2), "file": (REGULAR | permissions, 1), "symlink": (SYMLINK | 0o777, 1)}[kind]


def apply_events(tree: DataFrame, inodes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold an ordered log over the tree and inodes.

    events: seq, op, node_id, parent_id, name_id, inode_id, mode. op: create, mkdir, symlink, link (a node for an inode), rename (a node's new
    place; what stood there is overwritten), unlink, rmdir. A node's last event wins; links change by the sum of what the log adds and
    takes (a folder's removal takes both its links, its making gives its parent one more).
    """
    last = F.max_by(F.struct("op", "parent_id", "name_id", "inode_id"), "seq")
    now = events.filter(F.col("op") != "setattr").groupBy("node_id").agg(last.alias("l"), F.max_by(F.struct("inode_id"), F.when(F.col("inode_id").isNotNull(), F.col("seq"))).alias("i"), F.max("seq").alias("seq"))
    old = tree.select(F.col("id").alias("node_id"), F.col("parent_id").alias("_p"), F.col("name_id").alias("_n"), F.col("inode_id").alias("_i"))
    both = old.join(now, "node_id", "full")
    placed = both.select(
        F.col("node_id").alias("id"),
        F.when(F.col("l").isNull(), F.col("_p")).otherwise(F.coalesce("l.parent_id", "_p")).alias("parent_id"),
        F.when(F.col("l").isNull(), F.col("_n")).otherwise(F.coalesce("l.name_id", "_n")).alias("name_id"),
        F.coalesce("i.inode_id", "_i").alias("inode_id"),
        F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"),
        F.coalesce(F.col("l.op").isin("unlink", "rmdir"), F.lit(False)).alias("gone"),
    )
    kept = placed.filter(~F.col("gone"))
    # of nodes at one place the last moved there stays
    top = kept.filter("parent_id is not null").groupBy("parent_id", "name_id").agg(F.max(F.struct("seq", "id")).alias("t")).select(F.col("t.id").alias("id"))
    roots = kept.filter("parent_id is null")
    stay = kept.join(top, "id", "left_semi").unionByName(roots)
    over = kept.filter("parent_id is not null").join(top, "id", "left_anti")
    folder = inodes.select(F.col("id").alias("inode_id"), (F.col("mode").bitwiseAND(0o170000) == DIRECTORY).alias("dir"))
    lost = placed.filter("gone").select("inode_id").unionByName(over.select("inode_id")).join(folder, "inode_id", "left").select(F.col("inode_id").alias("id"), F.when(F.coalesce("dir", F.lit(False)), -2).otherwise(-1).alias("d"))
    linked = events.filter(F.col("op") == "link").select(F.col("inode_id").alias("id"), F.lit(1).alias("d"))
    made = events.filter(F.col("op").isin("create", "mkdir", "symlink")).select(F.col("inode_id").alias("id"), F.when(F.col("op") == "mkdir", 2).otherwise(1).alias("nlinks"), "mode")
    parents = events.filter(F.col("op") == "mkdir").join(tree.select(F.col("id").alias("parent_id"), F.col("inode_id").alias("_pi")), "parent_id").select(F.col("_pi").alias("id"), F.lit(1).alias("d"))
    every = inodes.select("id", "nlinks", "mode").unionByName(made.select("id", F.col("nlinks").cast("long").alias("nlinks"), "mode"))
    deltas = lost.unionByName(linked).unionByName(parents).groupBy("id").agg(F.sum("d").alias("d"))
    counted = every.join(deltas, "id", "left").select("id", (F.col("nlinks") + F.coalesce("d", F.lit(0))).alias("nlinks"), "mode")
    return stay.select("id", "parent_id", "name_id", "inode_id"), counted


def apply_setattr(inodes: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("size", "mode", "uid", "gid", "atime_ns", "mtime_ns", "ctime_ns")) -> DataFrame:
    """changes: seq, id and some columns (null: not set). Of each column the last value set wins; a smaller size marks the inode truncated."""
    have = [c for c in columns if c in changes.columns]
    last = changes.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in have])
    both = inodes.join(last, "id", "left")
    cut = (F.coalesce("_size", "size") < F.col("size")).alias("truncated") if "size" in have else F.lit(False).alias("truncated")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in have else F.col(c) for c in inodes.columns], cut)


def occupied(tree: DataFrame, inodes: DataFrame) -> DataFrame:
    """parent_id, n: how many linked entries each folder has; a folder that is not among them may be removed."""
    return tree.join(inodes.filter("nlinks <> 0").select(F.col("id").alias("inode_id")), "inode_id", "left_semi").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))


def refused(tree: DataFrame, inodes: DataFrame, events: DataFrame) -> DataFrame:
    """The rmdir events (seq, node_id) of folders that have linked entries when they come: entries of the tree, or made or moved there before, that no event has taken
    away or elsewhere by then. They must not be applied: a folder that isn't empty stays."""
    asked = events.filter(F.col("op") == "rmdir").select(F.col("seq").alias("_seq"), F.col("node_id").alias("_folder"))
    gone = inodes.filter("nlinks = 0").select(F.col("id").alias("inode_id"))
    old = tree.join(gone, "inode_id", "left_anti").select(F.lit(-1).cast("long").alias("seq"), F.col("id").alias("node_id"), F.col("parent_id").alias("place"))
    moved = events.filter(F.col("op").isin("create", "mkdir", "symlink", "link", "rename", "unlink", "rmdir"))
    moved = moved.select(F.col("seq").cast("long").alias("seq"), "node_id", F.when(~F.col("op").isin("unlink", "rmdir"), F.col("parent_id")).alias("place"))
    steps = old.unionByName(moved)
    inside = steps.join(asked, steps["place"] == asked["_folder"], "left_semi").select("node_id").distinct()  # nodes that ever were in such a folder
    until = steps.join(inside, "node_id", "left_semi").withColumn("_until", F.lead("seq").over(Window.partitionBy("node_id").orderBy("seq")))
    full = until.join(asked, (until["place"] == asked["_folder"]) & (until["seq"] < asked["_seq"]) & (F.coalesce(until["_until"], F.lit(2**62)) > asked["_seq"]))
    return full.select(F.col("_seq").alias("seq"), F.col("_folder").alias("node_id")).distinct()
