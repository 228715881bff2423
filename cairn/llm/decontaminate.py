"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts become lower-cased tokens (runs of letters and digits) and tokens 64-bit hashes. A mask is a fixed pattern that reads some of
the tokens from a place on and ignores the rest; the hash of what each mask reads is the key on which training texts and benchmark items
are joined. A hit puts a text and an item at one offset; there the tokens are compared one by one, and the pair is reported
where a window of WINDOW tokens has at least LEAST equal ones. Substitutions at ignored places don't disturb a mask, and the three masks
were chosen so that in every window, wherever its up to three substitutions are, at least one mask finds a hit.

An item with fewer tokens than WINDOW must match over its whole length: in four of five tokens, or in all where it has fewer than SHORTEST. Its masks
have its length, and each reads one of the parts that the item is cut into, one part more than it may have substitutions: so one part is always
whole, and no such match is missed. Texts are read by these masks only for the lengths that the benchmark has.

The seeds of the benchmark are rows of fixed width and are broadcast only while they take BROADCAST_BYTES at most; beyond that, narrow rows (hash, id, place) are
joined by shuffle and the few texts with hits are read again for the comparison.

Defined cases: null and empty texts have no tokens, and items without tokens are never reported; equal items are one, under their least id; of equally good windows the first is
reported; repeated rows of a text report once for each id; very long texts are compared at the places of hits only; null ids are one id; empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 is read, 0 ignored.
MASKS = ("11101011", "11010000111", "111001101")
WINDOW, LEAST = 15, 12
#: Fewer tokens than this must all be equal.
SHORTEST = min(map(len, MASKS))
#: The most that benchmark seeds may take where they are broadcast, and what one takes (two longs, two ints, the hash table's overhead).
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 64


def required(m: int) -> int:
    """How many tokens of an item's m (at most WINDOW of them) must be equal."""
    m = min(m, WINDOW)
    return m if m < SHORTEST else -(-m * LEAST // WINDOW)


def masks(m: int) -> list[str]:
    """The masks by which items of m tokens are searched."""
    if m >= WINDOW:
        return list(MASKS)
    parts = m - required(m) + 1
    cuts = [m * i // parts for i in range(parts + 1)]
    return ["0" * a + "1" * (b - a) + "0" * (m - b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def seeds(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """Rows with th (token hashes) -> keep, th, at, seed: one row for each place and mask of items of the given lengths."""
    every = [(m, k, mask) for m in lengths for k, mask in enumerate(masks(m))]
    n, least = F.size("th"), min([len(mask) for _, _, mask in every], default=1)
    placed = rows.filter(n >= least).select(*keep, "th", F.explode(F.sequence(F.lit(0), n - least)).alias("at"))

    def read(m: int, number: int, mask: str) -> Column:
        read = [F.get("th", F.col("at") + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("at") + len(mask) <= F.size("th"), F.xxhash64(F.lit(m * 256 + number), *read))

    masked = F.array(*[read(*x) for x in every]).cast("array<bigint>")
    return placed.select(*keep, *([] if "th" in keep else ["th"]), "at", F.explode(masked).alias("seed")).filter("seed is not null")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, ith: distinct token sequences."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), hashes(benchmark["text"]).alias("ith"))
    return rows.groupBy("ith").agg(F.min("item_id").alias("item_id")).filter(F.size("ith") > 0)


def _aligned(offset: Column, n: Column, m: Column) -> tuple[Column, Column, Column]:
    """Where a text of n and an item of m tokens overlap at an offset: start in either, and length."""
    a, b = F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
    return a, b, F.least(n - a, m - b)


def _verify(hits: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, offset, part (the text's hashes where it overlaps the item) -> the pairs that hold, each with its best window."""
    rows = hits.join(items, "item_id")
    b = F.greatest(-F.col("offset"), F.lit(0))
    same = F.zip_with("part", F.slice("ith", b + 1, F.size("part")), lambda x, y: F.when(x == y, 1).otherwise(0))
    width = F.least(F.lit(WINDOW), F.size("ith"))
    rows = rows.select("doc_id", "item_id", "offset", width.alias("width"), same.alias("same")).filter(F.size("same") >= F.col("width"))
    windows = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("width")), lambda j: F.aggregate(F.slice("same", j + 1, F.col("width")), F.lit(0), lambda s, x: s + x))
    rows = rows.withColumn("windows", windows).withColumn("matches", F.array_max("windows"))
    rows = rows.filter(F.col("matches") >= F.when(F.col("width") < SHORTEST, F.col("width")).otherwise(F.ceil(F.col("width") * LEAST / WINDOW)))
    start = (F.array_position("windows", F.col("matches")) - 1 + F.greatest("offset", F.lit(0))).cast("int")
    best = F.max(F.struct("matches", (-start).alias("before"), "width"))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", (-F.col("best.before")).alias("doc_token"), F.col("best.width").alias("n_tokens"), F.col("best.matches").alias("n_equal"))


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, doc_token (where the best window starts), n_tokens, n_equal, for every text and item that overlap."""
    items = _items(benchmark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), hashes(docs["text"]).alias("th"))
    size = F.least(F.size("ith"), F.lit(WINDOW))
    sizes = {r.m: (r.items, r.tokens) for r in items.groupBy(size.alias("m")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("ith")).alias("tokens")).collect()}  # at most WINDOW rows
    count = sum(tokens * len(MASKS) if m == WINDOW else items * len(masks(m)) for m, (items, tokens) in sizes.items())
    lengths = sorted(sizes) or [WINDOW]
    own = [seeds(items.filter(size == m).withColumnRenamed("ith", "th"), [m], "item_id") for m in lengths]
    item_seeds = reduce(DataFrame.union, own).select("seed", "item_id", F.col("at").alias("item_at"), F.size("th").alias("m"))
    offset = (F.col("at") - F.col("item_at")).alias("offset")
    a, _, length = _aligned(F.col("offset"), F.size("th"), F.col("m"))
    part = F.slice("th", a + 1, length).alias("part")
    if count * SEED_BYTES <= broadcast_bytes:
        hits = seeds(rows, lengths, "doc_id").join(F.broadcast(item_seeds), "seed")
        hits = hits.select("doc_id", "item_id", offset, "th", "m").select("doc_id", "item_id", "offset", part).distinct()
    else:
        placed = seeds(rows, lengths, "doc_id").select("seed", "doc_id", "at")
        found = placed.join(item_seeds, "seed").select("doc_id", "item_id", offset, "m").distinct()
        again = rows.withColumnRenamed("doc_id", "_id")
        hits = found.join(again, found["doc_id"].eqNullSafe(again["_id"])).select("doc_id", "item_id", "offset", part).distinct()
    return _verify(hits, items)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text overlaps no item."""
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["_id"]), "left_anti")
