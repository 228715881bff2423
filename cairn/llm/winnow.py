"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; of each window of w successive hashes the least is chosen, of equal ones the
rightmost. Positions are kept, so that any passage of w + k - 1 code points that two texts share gives them a fingerprint
entry in common, at known places. A fingerprint is written as hex: for each entry one byte for the distance from the
entry before (at most w; the first from -1) and four for the hash.

Defined cases: null text is empty; an empty text has the empty fingerprint; a text under k code points has one entry, the hash of
the whole; two empty fingerprints are alike (1), an empty and another are not (0). A null doc_id comes before all ids; rows of
one doc_id follow in order of their text's hash and text, so that repeated rows are each other's neighbours; the only row of a table is
its own neighbour; a very long text is worked on whole, in memory of some 100 bytes for each code point; all rows of one doc_id are one run, as each needs the next; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import id_text, mix

K, W = 16, 32
BASE = np.uint64(0x9E3779B97F4A7C15)
#: The most ranges of doc_id (eight for each task of a shuffle); each becomes one run of rows that are worked through in order.
RANGES = 1 << 16


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Polynomial hashes of all k-grams, built by doubling, spread to 32 bits."""
    h, size, power = points.astype(np.uint64) + np.uint64(1), 1, BASE
    rest, rest_size = None, 0
    while True:
        if k & size:
            if rest is None:
                rest, rest_size = h, size
            else:
                n = min(len(rest) - size, len(h) - rest_size)
                rest, rest_size = rest[:n] + h[rest_size : rest_size + n] * BASE ** np.uint64(rest_size), rest_size + size
        if size * 2 > k:
            return mix(rest) >> np.uint64(32)
        h, power, size = h[:-size] + h[size:] * power, power * power, size * 2


def select(points: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions (ascending) and their 32-bit hashes."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        h = gram_hashes(points, min(k, len(points)))
    last = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (last - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is the least
    width = min(w, len(key))
    low, size = key, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(key) - width + 1], low[width - size :][: len(key) - width + 1])
    low = low[np.r_[True, low[1:] != low[:-1]]]
    return (last - (low & last)).astype(np.int64), (low >> np.uint64(32)).astype(np.uint32)


def write(positions: np.ndarray, hashes: np.ndarray) -> str:
    out = np.empty((len(hashes), 5), np.uint8)
    out[:, 0] = np.diff(positions, prepend=-1)
    out[:, 1:] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The positions and hashes that a fingerprint holds."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 0].astype(np.int64)) - 1, raw[:, 1:].copy().view(">u4").ravel().astype(np.uint32)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the distinct hashes in common over the distinct hashes of both (sorted distinct inputs)."""
    if not len(a) and not len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint and its distinct hashes, sorted."""
    positions, hashes = select(points_of(text))
    return write(positions, hashes), np.unique(hashes)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _longs(values: list[int | None]) -> Column:
    """A constant array, however long."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _run_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below key: found among every `step`-th one first, then among those up to the next."""
    step = max(1, math.isqrt(len(bounds)))
    below = lambda among: F.size(F.filter(among, lambda x: x < key))
    part = F.greatest(below(_longs(bounds[::step])) - 1, F.lit(0)) * step
    return part + below(F.slice(_longs(bounds), part + 1, F.lit(step)))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, run, guest: rows dealt by ranges of doc_id and sorted, each run closed by a guest, the next run's first row.

    The ranges' bounds (approximate quantiles) and first ids are the only values that reach the driver: at most RANGES of each.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    runs = min(RANGES, 8 * n)
    bounds = rows.agg(F.percentile_approx("key", [i / runs for i in range(1, runs)], min(100 * runs, 1 << 20))).first()[0]
    bounds = sorted(set(bounds or []))
    rows = rows.withColumn("run", (_run_of(F.col("key"), bounds) if bounds else F.lit(0)).cast("int"))
    first = dict(rows.groupBy("run").agg(F.min("key")).collect())
    order = sorted(first)
    if not order:
        return rows.select("doc_id", "text", "run", F.lit(False).alias("guest"))
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the run that a run's first row closes as a guest; the first of all closes the last run
    at = range(order[-1] + 1)
    closes = F.when(F.get(_longs([first.get(r) for r in at]), F.col("run")) == F.col("key"), F.get(_longs([before.get(r) for r in at]), F.col("run"))).cast("int")
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    rows = rows.withColumn("closes", closes).withColumn("at", F.explode(F.when(F.col("closes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("closes").alias("run"), F.lit(True).alias("guest"))))))
    rows = rows.select("doc_id", "text", "key", F.xxhash64("text").alias("tie"), "at.run", "at.guest")
    rows = rows.repartition(n, "run").sortWithinPartitions("run", "guest", "key", "tie", "text")
    return rows.select("doc_id", "text", "run", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, its edited text's, and how alike both and the next document's are."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row = None  # id, text, run, fingerprint, hashes
        out: list[tuple] = []
        for batch in batches:
            ids, runs, guests = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if open_row is None and guests[i]:
                    continue  # a further row of a guest's id
                now, hashes = fingerprint(text)
                if open_row is not None and open_row[2] == runs[i]:
                    was_id, was, _, was_now, was_hashes = open_row
                    other = edited(was, text)
                    other_now, other_hashes = fingerprint(other)
                    out.append((was_id, len(was), hashlib.sha256(other.encode()).hexdigest(), was_now, other_now, likeness(was_hashes, other_hashes), likeness(was_hashes, hashes)))
                open_row = None if guests[i] else (ids[i], text, runs[i], now, hashes)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
