"""Substring dedup: words covered by a window of WINDOW words whose sequence also starts elsewhere are removed.

Texts are streams of word hashes. Windows go to shards by content: a window's minimiser is the least hash of its grams (GRAMS[0] words),
equal windows have equal minimisers, and successive windows with one minimiser travel as one segment. Only minimisers that
occur more than once are looked at further. Equal segments are one, held twice. Each shard builds a compressed FM-index over its segments
and streams them against it: backward search over the wavelet matrix gives the matching statistics at window ends, cut off at
WINDOW; those that reach it are repeated windows, and the interval from the first to the last of a segment is reported.

A shard takes whole minimisers, up to SHARD words. A minimiser with more than HOT different segments is split into shards of its own: its segments are cut
anew by longer minimisers (GRAMS[1] words, then, where that is as crowded, WINDOW words, which only equal windows share), so that no shard's index grows with the input.

Texts aren't moved to where their repeats are known. Chosen places of segments and texts with spans are marked in bitmaps of fixed size that go
to every task; a task hands on only what is marked, and exact joins sort out what is marked by chance.

Defined cases: null and empty texts have no words; texts under WINDOW words keep all; a window that overlaps its copy in the same
text counts; repeated rows are copies of each other; null doc_ids are ids of their own; of equal segments the least place is read; a very long text is worked
on whole, in memory of some 60 bytes for each of its; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bitmap, checkpoint, id_text, in_bitmap, mix, spread_join, utf8
from cairn.llm.fmindex import FMIndex

WINDOW, GRAMS = 35, (16, 28, 35)
SHARD, HOT = 150_000, 1024
#: Places that a task remembers, to hand each on but once.
SEEN = 1 << 16
#: Bytes of text whose words are hashed at once.
PORTION = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of the base and its inverse, as far as a portion has needed them."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]) for b in (_BASE, _INVERSE))
        return cls.up, cls.down


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of values (their polynomial, moved to place 0, spread)."""
    up, down = _Powers.to(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of texts that lie one after another, and the number of words before each text."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = at[(at > 0) & (at < len(raw))]
    begins[edge] |= word[edge]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[edge - 1] |= word[edge - 1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, at)


def portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of bounded stretches of a batch; one text is never split."""
    raw, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PORTION, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def segments(h: np.ndarray, first: np.ndarray, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and each text's first word -> segments: first window, windows, minimiser (48 bits), hash of its words."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2
    # the hash of gram words by doubling, the bits of gram from the lowest on
    g, size, done, done_size = h, 1, None, 0
    up = np.uint64(_BASE)
    while True:
        if gram & size:
            done, done_size = (g, size) if done is None else (done[: len(h) - done_size - size + 1] + g[done_size : len(h) - size + 1] * np.uint64(pow(_BASE, done_size, 2**64)), done_size + size)
        if size * 2 > gram:
            break
        g, size, up = g[:-size] + g[size:] * up, size * 2, np.uint64(int(up) ** 2 % 2**64)
    g = (mix(done) & np.uint64(0xFFFFFFFFFFFF0000)) | (np.uint64(0xFFFF) - (np.arange(len(done), dtype=np.uint64) & np.uint64(0xFFFF)))
    width, low, size = WINDOW - gram + 1, g, 1
    while size * 2 <= width:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[:n], low[width - size :][:n])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n] == text[WINDOW - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    # a segment ends before the next one, or where its text's windows end
    count = np.minimum(np.r_[start[1:], n], first[text[start] + 1] - WINDOW + 1) - start
    return start, count, (low[start] >> np.uint64(16)).view(np.int64), _spans(h, start, start + count + WINDOW - 1).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, id (null ids apart), rid: equal rows share (id, rid)."""
    return id_text(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("rid", F.xxhash64("doc_id", "text"))


def occurrences(rows: DataFrame) -> DataFrame:
    """Every segment of every text: id, rid, start, count, times, minimiser, segment.

    In a periodic stretch equal segments follow one another, count words apart: they are one row with times over 1.
    """
    schema = "id long, rid long, start int, count int, times int, minimiser long, segment long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, raw, at in portions(batch, 2):
                starts, ends, first = words_of(raw, at)
                start, count, low, whole = segments(_spans(raw, starts, ends), first)
                row = np.searchsorted(first, start, "right") - 1
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (low[1:] != low[:-1]) | (whole[1:] != whole[:-1]) | (start[1:] != start[:-1] + count[:-1])][: len(row)])
                times = np.diff(np.r_[new, len(row)])
                row, start, count, low, whole = (x[new] for x in (row, start, count, low, whole))
                cols = [ids[lo:hi][row], rids[lo:hi][row], (start - first[row]).astype(np.int32), count.astype(np.int32), times.astype(np.int32), low, whole]
                yield pa.record_batch([pa.array(x) for x in cols], ["id", "rid", "start", "count", "times", "minimiser", "segment"])

    return rows.select("id", "rid", "text").mapInArrow(run, schema)


def repeated_minimisers(found: DataFrame) -> DataFrame:
    """The rows whose minimiser has another row (or which stand for several), in one pass over rows dealt and sorted by minimiser."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, repeated = None, False  # the last row so far, and whether it is known to be repeated
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = batch.column(5).to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            keep = np.r_[False, same] | np.r_[same, False] | (batch.column(4).to_numpy() > 1)
            keep[0] |= held is not None and repeated
            repeated, held = bool(keep[-1]), batch.slice(len(key) - 1)
            yield batch.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        if held is not None and repeated:
            yield held

    return found.repartition(n, "minimiser").sortWithinPartitions("minimiser").mapInArrow(run, found.schema)


def _place(rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(rid.view(np.uint64) ^ mix(start.astype(np.uint64) + np.uint64(1)))


def extract(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: one place of each segment (rid, start). Every place marked by them: rid, start, minimiser, segment, count, words (and some marked by chance)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_place(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))], ["place"])

    shared = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select("rid", "start").mapInArrow(hashed, "place long"), "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, np.zeros(0, np.uint64)
        for batch in batches:
            rids = batch.column(0).to_numpy()
            if len(seen) > SEEN:
                seen = seen[:0]
            for lo, hi, raw, at in portions(batch, 1):
                starts, ends, first = words_of(raw, at)
                h = _spans(raw, starts, ends)
                start, count, low, whole = segments(h, first)
                row = np.searchsorted(first, start, "right") - 1
                rid, within = rids[lo:hi][row], start - first[row]
                place = _place(rid, within)
                good = np.flatnonzero(in_bitmap(bits, place))
                good = good[np.unique(place[good], return_index=True)[1]]  # equal rows hand on a place once
                good = good[~np.isin(place[good], seen)]
                seen = np.r_[seen, place[good]]
                words = [h[a : a + n + WINDOW - 1].tobytes() for a, n in zip(start[good].tolist(), count[good].tolist(), strict=True)]
                yield pa.record_batch([pa.array(rid[good]), pa.array(within[good].astype(np.int32)), pa.array(low[good]), pa.array(whole[good]), pa.array(count[good].astype(np.int32)), pa.array(words, pa.binary())], ["rid", "start", "minimiser", "segment", "count", "words"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, start int, minimiser long, segment long, count int, words binary")


def recut(found: DataFrame, gram: int) -> DataFrame:
    """Segments (minimiser, segment, count, n, words, owner, skipped) cut anew by longer minimisers, below their own: the pieces, with the segment that each is of and where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = part.column(4).to_pylist()
                sizes = np.array([len(w) // 8 for w in words], np.int64)
                h, first = np.frombuffer(b"".join(words), np.uint64), np.r_[0, np.cumsum(sizes)]
                start, count, low, whole = segments(h, first, gram)
                row = np.searchsorted(first, start, "right") - 1
                key = mix(part.column(0).to_numpy().view(np.uint64)[row] ^ mix(low.view(np.uint64) + np.uint64(gram))).view(np.int64)
                skipped = part.column(6).to_numpy()[row] + (start - first[row])
                said = [h[a : a + n + WINDOW - 1].tobytes() for a, n in zip(start.tolist(), count.tolist(), strict=True)]
                yield pa.record_batch([pa.array(key), pa.array(whole), pa.array(count.astype(np.int32)), pa.array(part.column(3).to_numpy()[row]), pa.array(said, pa.binary()), pa.array(part.column(5).to_numpy()[row]), pa.array(skipped.astype(np.int32))], names)

    names = ["minimiser", "segment", "count", "n", "words", "owner", "skipped"]
    return found.select(*names).mapInArrow(run, "minimiser long, segment long, count int, n long, words binary, owner long, skipped int")


def search(minimiser: np.ndarray, count: np.ndarray, copies: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments of one shard -> the first and last repeated window of each (-1 where there is none), by their FM-index."""
    sizes = count + WINDOW - 1
    h = np.frombuffer(b"".join(words), np.uint64)
    known, ids = np.unique(h, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # 0 parts the segments; a segment that occurs more than once is held twice
    twice = np.repeat(copies > 1, sizes)
    owner = np.repeat(np.arange(len(count)), sizes)

    def joined(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) + 1 if len(owner) else np.zeros(0, np.int64)
        return np.insert(symbols, ends, 0)

    text = np.concatenate([joined(ids + 1, owner), joined(ids[twice] + 1, owner[twice])])
    index = FMIndex(text, len(known) + 1, WINDOW)
    first, last = np.full(len(count), -1), np.full(len(count), -1)
    # from the left: a stretch that is unique rules out every window around it, up to the one that starts after its first word
    todo, s = np.arange(len(count)), np.zeros(len(count), np.int64)
    while len(todo):
        length = index.matching_statistics(ids + 1, starts[todo] + s + WINDOW - 1, WINDOW)
        hit = length == WINDOW
        first[todo[hit]] = s[hit]
        s = (s + WINDOW - length)[~hit]
        todo = todo[~hit]
        todo, s = todo[s < count[todo]], s[s < count[todo]]
    # from the right, down to the first
    todo = np.flatnonzero(first >= 0)
    s = count[todo] - 1
    while len(todo):
        reached = s == first[todo]
        last[todo[reached]] = s[reached]
        todo, s = todo[~reached], s[~reached]
        hit = index.matching_statistics(ids + 1, starts[todo] + s + WINDOW - 1, WINDOW) == WINDOW
        last[todo[hit]] = s[hit]
        todo, s = todo[~hit], s[~hit] - 1
    return first, last


def _chosen(t: pa.Table) -> pa.Table:
    """Sorted by minimiser, segment and n: a wanted place of each segment (n, no words) is followed by what was extracted (no n): of that, the first from that place."""
    key, seg, rid, start = (t.column(i).to_numpy() for i in (0, 1, 5, 6))
    n = t.column(3).fill_null(0).to_numpy()
    asked = np.maximum.accumulate(np.where(n > 0, np.arange(len(n)), -1))
    good = np.flatnonzero((n == 0) & (asked >= 0))
    of = asked[good]
    same = (key[good] == key[of]) & (seg[good] == seg[of]) & (rid[good] == rid[of]) & (start[good] == start[of])
    good, of = good[same], of[same]
    new = np.r_[True, of[1:] != of[:-1]][: len(of)]
    good, of = good[new], of[new]
    out = t.take(pa.array(good))
    return out.set_column(3, "n", pa.array(n[of]))


def indexed(found: DataFrame, chosen: bool = False) -> DataFrame:
    """minimiser, segment, count, n, words -> minimiser, segment, first, last: the repeated windows' bounds, by the FM-index of each shard.

    chosen: found holds wanted places and extracted ones, with rid and start, and only the wanted are indexed.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "minimiser long, segment long, first int, last int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0

        def shard(t: pa.Table) -> pa.RecordBatch:
            t = _chosen(t) if chosen else t
            key, seg, count, copies = (t.column(i).to_numpy() for i in range(4))
            first, last = search(key, count.astype(np.int64), copies, t.column(4).to_pylist()) if len(key) else (np.zeros(0, np.int64),) * 2
            good = first >= 0
            return pa.record_batch([pa.array(x[good]) for x in (key, seg, first.astype(np.int32), last.astype(np.int32))], ["minimiser", "segment", "first", "last"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.append(part)
                words += part.num_rows * (22 if chosen else 45)
                if words >= SHARD:  # the last minimiser may go on; what is before it is a shard
                    t = pa.Table.from_batches(held)
                    key = t.column(0).to_numpy()
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield shard(t.slice(0, cut))
                        held = t.slice(cut).to_batches()
                        words = (len(key) - cut) * 45
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield shard(t)

    found = found.select("minimiser", "segment", "count", "n", "words", *(["rid", "start"] if chosen else []))
    return found.repartition(n, "minimiser").sortWithinPartitions("minimiser", *(["segment", F.desc_nulls_last("n")] if chosen else [])).mapInArrow(run, schema)


def crowded(found: DataFrame) -> DataFrame:
    """found with hot: whether a row's minimiser has more than HOT rows (distinct segments)."""
    counts = found.groupBy("minimiser").agg(F.count(F.lit(1)).alias("rows")).withColumn("hot", F.col("rows") > HOT)
    return spread_join(found, counts.select("minimiser", "hot", "rows"), "minimiser", "rows")


def repeated_windows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: one place of each segment (rid, start, minimiser, segment, n, hot) -> segment, first, last: the repeated windows' bounds, counted in windows of the segment."""
    cold = wanted.filter("not hot")
    asked = cold.select("rid", "start", "minimiser", "segment", F.lit(None).cast("int").alias("count"), F.lit(None).cast("binary").alias("words"), "n")
    both = asked.unionByName(extract(rows, cold).withColumn("n", F.lit(None).cast("long")))
    out = checkpoint(indexed(both, chosen=True), free=True).select("segment", "first", "last")
    hot = wanted.filter("hot").drop("hot")
    if not hot.head(1):
        return out
    left = extract(rows, hot).join(hot, ["minimiser", "segment", "rid", "start"]).groupBy("minimiser", "segment").agg(F.first("count").alias("count"), F.max("n").alias("n"), F.first("words").alias("words"))
    left = checkpoint(left.withColumn("owner", F.col("segment")).withColumn("skipped", F.lit(0)))
    for gram in GRAMS[1:]:
        pieces = checkpoint(recut(left, gram))
        distinct = pieces.groupBy("minimiser", "segment").agg(F.sum("n").alias("n"), F.first("count").alias("count"), F.first("words").alias("words")).select("minimiser", "segment", "count", "n", "words")
        distinct = checkpoint(crowded(distinct) if gram < WINDOW else distinct.withColumn("hot", F.lit(False)))
        own = pieces.select("minimiser", "segment", "owner", "skipped")
        found = own.join(indexed(distinct.filter("not hot")), ["minimiser", "segment"]).groupBy("owner").agg(F.min(F.col("skipped") + F.col("first")).cast("int").alias("first"), F.max(F.col("skipped") + F.col("last")).cast("int").alias("last"))
        out = out.unionByName(found.select(F.col("owner").alias("segment"), "first", "last"))
        crowd = distinct.filter("hot").select("minimiser", "segment")
        if not crowd.head(1):
            break
        left = checkpoint(pieces.join(crowd, ["minimiser", "segment"], "left_semi"))
    return out.groupBy("segment").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def merged(spans: Column) -> Column:
    """Sorted stretches (start, end) with those that touch made one."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """keyed rows -> rid, spans: the stretches of words to remove (start, end), for the texts that have any; pieces: how many rows they were made of."""
    found = checkpoint(repeated_minimisers(occurrences(rows)), free=True)
    one = found.groupBy("minimiser", "segment").agg(F.sum("times").alias("n"), F.min(F.struct("rid", "start")).alias("place")).select("place.*", "minimiser", "segment", "n")
    one = checkpoint(crowded(one))
    bounds = repeated_windows(rows, one)
    bounds = checkpoint(bounds.join(one.select("segment", "n"), "segment"))
    end = F.col("start") + (F.col("times") - 1) * F.col("count") + F.col("last") + WINDOW
    spans = spread_join(found.select("rid", "start", "count", "times", "segment"), bounds, "segment", "n").select("rid", F.struct((F.col("start") + F.col("first")).alias("start"), end.alias("end")).alias("span"))
    return spans.groupBy("rid").agg(merged(F.sort_array(F.collect_set("span"))).alias("spans"), F.count(F.lit(1)).alias("pieces"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left, joined by one blank."""
    rows = keyed(docs).select("doc_id", "rid", "text")
    spans = checkpoint(repeated_spans(keyed(docs)), free=True)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(spans, "rid"))

    def marked(wanted: bool) -> Callable:
        """The rows whose text is, or isn't, marked as having spans."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(1).to_numpy().view(np.uint64)) == wanted))

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, removed, kept = [], [], []
                for text, spans in zip(part.column(2), part.column(3) if part.num_columns > 3 else repeat(None), strict=False):
                    words = text.as_buffer().to_pybytes().split()
                    total, left, upto = len(words), [], 0
                    for s in (spans.as_py() if spans is not None else None) or ():
                        left += words[upto : s["start"]]
                        upto = max(upto, s["end"])
                    left += words[upto:]
                    n.append(total)
                    removed.append(total - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    out = "doc_id long, n_words long, n_removed long, kept string"
    near = spread_join(rows.mapInArrow(marked(True), rows.schema), spans, "rid", "pieces", "left")
    far = marked(False)
    return near.mapInArrow(run, out).union(rows.mapInArrow(lambda batches: run(far(batches)), out))
