"""Sharding by fixed virtual slots.

Records (id, text's checksum and length, number among equal rows) hash into a fixed number of virtual slots, bytes are aggregated per slot, and a
small versioned map takes slots to shards. Rebalancing edits the map, never the hash: only the rows of moved slots change their shard.

The law is `bytes`: shards get near equal bytes (longest slot first onto the lightest shard). What reaches the driver is
one row per virtual slot, bounded by the parameter n_slots.

Defined cases: null text has no bytes and crc 0 (size 1, as every row costs one byte); a null doc_id is a value of its own; rows that share an
id, or all have none, are spread by their texts, and equal rows, numbered, over all slots (in as many stretches as there are slots); all are kept, each at a place of its own;
one very long text makes its shard larger, as texts are never cut; of equally full shards the first takes a slot; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint

N_SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of every virtual slot."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, v, s) for v, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, n_shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table; older versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        maps = spark.read.parquet(path)
        version = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = maps.filter(F.col("version") == version).orderBy("vslot").collect()
        return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def first_map(bytes_of: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: heaviest slot first, each onto the shard that is lightest so far; slots without rows are dealt in turn."""
    heap = [(0, s) for s in range(n_shards)]
    shard_of = [v % n_shards for v in range(n_slots)]
    for v, n in sorted(bytes_of.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        shard_of[v] = s
        heapq.heappush(heap, (load + n, s))
    return SlotMap(1, n_shards, tuple(shard_of))


def rebalance(m: SlotMap, bytes_of: dict[int, int], n_shards: int | None = None) -> SlotMap:
    """The next version: move slots from the heaviest shards to the lightest while that makes them more even, and no others.

    More shards than before: slots move into the new ones only. Fewer: the slots of those that go are dealt out first.
    """
    n_shards = n_shards or m.n_shards
    targets = range(m.n_shards, n_shards) if n_shards > m.n_shards else range(n_shards)
    shard_of, load, held = list(m.shard_of), [0] * n_shards, [[] for _ in range(n_shards)]
    for v, s in enumerate(shard_of):
        if s >= n_shards:
            shard_of[v] = s = min(range(n_shards), key=load.__getitem__)
        load[s] += bytes_of.get(v, 0)
        if bytes_of.get(v):
            held[s].append((bytes_of[v], v))
    for own in held:
        own.sort()
    while True:
        top, low = max(range(n_shards), key=load.__getitem__), min(targets, key=load.__getitem__)
        gap = load[top] - load[low]
        fits = [x for x in held[top] if x[0] < gap]
        if not fits:
            return replace(m, version=m.version + 1, n_shards=n_shards, shard_of=tuple(shard_of))
        n, v = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        held[top].remove((n, v))
        held[low].append((n, v))
        shard_of[v] = low
        load[top] -= n
        load[low] += n


def sized_rows(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, copy and copies: equal rows are counted before the shuffle, so a hot row is one row, and then dealt to
    virtual slots in stretches of copies (number `copy` and the `copies - 1` that follow), at most one stretch a slot."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("all"))
    length = F.ceil(F.col("all") / n_slots)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, length)))
    vslot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32") + F.floor(F.col("copy") / length), F.lit(n_slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", vslot.alias("vslot"), "copy", F.least(length, F.col("all") - F.col("copy")).alias("copies"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n_rows"))


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot: slot numbers the rows of a shard from 0 without gaps, by vslot, doc_id, crc.

    Only narrow rows are shuffled. The sums of each virtual slot give the map and every slot's first number, so that numbering
    needs order within one virtual slot only.
    """
    spark = docs.sparkSession
    rows = checkpoint(sized_rows(docs, n_slots))  # one pass over the texts, for the sums and the result
    sums = {r.vslot: (r.bytes, r.n_rows) for r in slot_bytes(rows).collect()}  # at most n_slots rows
    m = slot_map or first_map({v: x[0] for v, x in sums.items()}, n_shards, n_slots)
    taken, placed = [0] * m.n_shards, []
    for v in sorted(sums):
        s = m.shard_of[v]
        placed.append((v, s, taken[s]))
        taken[s] += sums[v][1]
    places = spark.createDataFrame(placed, "vslot int, shard int, first long")
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy")
    rows = rows.withColumn("before", F.sum("copies").over(own) - F.col("copies")).join(F.broadcast(places), "vslot")  # at most n_slots rows
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("first") + F.col("before") + F.col("number")).alias("slot"))
