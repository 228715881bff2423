"""What the operators of this package share: input rows, lineage cuts, numpy views of Arrow text."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other bytes than these: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where that is unset, one of our own, which only a local master may use."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut df's lineage in the shared folder. free: first give back the shuffle files of lineages cut before, to which nothing refers any more."""
    checkpoint_folder(df.sparkSession)
    if free:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()  # Spark's cleaner takes what the driver's collector finds
    return df.checkpoint(eager=True)


#: Rows that go to a Python worker at once: with long texts, this bounds a worker's memory.
BATCH_ROWS = 4096


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows for this session's Python stages."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: A key with more than this share of all rows is hot; there are fewer such keys than HOT_SHARE.
HOT_SHARE = 1024


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key; its column `rows` says how many rows of left have the key, and isn't returned).

    The hot keys of right, fewer than HOT_SHARE of them, are broadcast, and the rows of left that have one are spread over all tasks;
    the other rows are dealt by key, so that no task gets more than a small share.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_SHARE > total
    packed = right.select(F.col(key).alias("_key"), F.struct(*(c for c in right.columns if c not in (key, rows))).alias("_got"), rows)
    often = packed.filter(hot).select("_key", F.col("_got").alias("_hot"))
    seldom = packed.filter(~hot).select("_key", "_got", F.lit(False).alias("_spread"))
    own = left.join(F.broadcast(often), left[key] == often["_key"], "left").drop("_key")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    own = own.withColumn("_mine", F.when(spread, F.xxhash64(*left.columns)).otherwise(F.col(key))).withColumn("_away", spread)
    out = own.join(seldom, (own["_away"] == seldom["_spread"]) & (own["_mine"] == seldom["_key"]), "left")
    got = F.coalesce("_hot", "_got")
    if how == "inner":
        out = out.filter(got.isNotNull())
    return out.select(*left.columns, *(got[c].alias(c) for c in right.columns if c not in (key, rows)))


#: Bits of a bitmap that tells tasks which of very many hashes may be wanted; its size is fixed, whatever their number.
BITMAP = 1 << 26


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """The bitmap in which the places (upper bits) of a column's 64-bit hashes are set."""
    place = F.shiftrightunsigned(column, 65 - BITMAP.bit_length())
    bits = df.select(place.alias("place")).selectExpr("shiftright(place, 6) as word", "shiftleft(1L, cast(place & 63 as int)) as bit")
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITMAP / 64 rows
    out = np.zeros(BITMAP // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be among those that the bitmap was made of."""
    place = hashes >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns under fixed names (doc_id, text; null text: empty), whatever else docs holds."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n+1 offsets into them, without a copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
