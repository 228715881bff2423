"""Line dedup: lines alike to another are one component, of which one line stays.

A line is what line feeds part, without white space at its ends; blank lines are kept and not compared. Character shingles (SHINGLE
code points; a shorter line is one shingle) give a MinHash signature (by one permutation) of BANDS bands of ROWS values; lines that agree in a band
are candidates: pairs at similarity SIMILARITY are missed with a probability of (1 - 0.8**6)**18 = 0.4 % (short lines: 10 bands of 4, 0.5 %). Candidates are verified
by the exact Jaccard similarity of their shingle sets, and the links joined by distributed union-find. Of each component the first line stays, by
doc_id and number.

Equal lines are one vertex before anything is compared. A line's 96-bit sketch travels with its band values, and only lines whose sketches
leave it open that they are alike go on to have their texts compared. A band value shared by many lines is searched for a spanning forest of its
links, not for all pairs, and is split into pairs of blocks over BLOCK lines; groups of the same members are searched once.

Defined cases: null and empty texts are one blank line; rows equal in doc_id and text share what happens to their lines; null
doc_ids come first; of alike lines at one place (rows of one id) the one of least row hash stays; very long texts are worked on whole, one at a
time, in memory of some 60 bytes for each of theirs; an empty table gives no rows; further columns are ignored, or kept as they are by dedup_lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bitmap, checkpoint, in_bitmap, mix, spread_join, unused, utf8
from cairn.llm.components import components
from cairn.llm.substring import _spans, keyed

SHINGLE, BANDS, ROWS = 4, 18, 6
#: Short lines have few shingles for BANDS * ROWS bins: they are banded by SHORT (bands, rows) instead. Lines with a number of full bins
#: in EITHER are banded both ways, so that a line finds those that are alike on both sides of the border.
SHORT, EITHER = (10, 4), (50, 70)
SIMILARITY = 0.8
BLOCK, FAN = 512, 32
#: Lines that a task remembers, to post each but once.
SEEN = 100_000
#: Bytes of text worked on at once.
PORTION = 1 << 18
#: Sketches of two lines: of the long kind at most APART of 96 bits differ where lines are alike (10 are expected at SIMILARITY, 22 are four deviations more);
#: of the short kind there are PARITIES bits, and counts of shingles up to MANY.
APART, PARITIES, MANY = 22, 89, 127
#: Postings that a task holds; in a packed row; buckets of postings for each task that gathers them.
HELD, PACK, BUCKETS = 1 << 18, 32, 8
#: Of BANDS * ROWS half bytes of two signatures of the long kind as many agree where lines are alike (88 are expected at SIMILARITY, 66 are four deviations less).
AGREE = 66
#: A group with more pairs for each member than this is searched as a whole.
PAIRS = 4

#: A bin without a shingle.
EMPTY = np.uint32(0xFFFFFFFF)


def lines_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts that lie one after another -> text, number, start and end (white space trimmed) of every line."""
    feeds = np.flatnonzero(raw == 10)
    of_feed = np.searchsorted(at, feeds, "right") - 1
    text = np.concatenate([np.arange(len(at) - 1), of_feed])
    start = np.concatenate([at[:-1], feeds + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    end = np.where(last, at[text + 1], np.r_[start[1:], 0] - 1)
    number = np.arange(len(text)) - np.searchsorted(text, text)
    ink = np.flatnonzero(~((raw == 32) | ((raw >= 9) & (raw <= 13))))
    lo, hi = np.searchsorted(ink, start), np.searchsorted(ink, end)
    full = hi > lo
    start, end = start.copy(), end.copy()
    start[full], end[full] = ink[lo[full]], ink[hi[full] - 1] + 1
    end[~full] = start[~full]
    return text, number, start, end


def shingles(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each stretch, repeats included, and where each stretch's begin."""
    if (high := raw >= 0x80).any():
        chars = np.flatnonzero(~high | (raw >= 0xC0))
        point = raw[chars].astype(np.uint64)
        wide = np.flatnonzero(point >= 0xC0)  # characters of more bytes: the 1 to 3 that follow belong to them
        longer, at = np.r_[raw, np.zeros(3, np.uint8)], chars[wide]
        more = np.ones(len(wide), bool)
        for i in (1, 2, 3):
            more &= (longer[at + i] & 0xC0) == 0x80
            point[wide] |= np.where(more, longer[at + i], 0).astype(np.uint64) << np.uint64(8 * i)
        a, b = np.searchsorted(chars, start), np.searchsorted(chars, end)
    else:
        point, a, b = raw.astype(np.uint64), start, end
    gram, size, power = point + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while size < SHINGLE:
        gram, size, power = gram[:-size] + gram[size:] * power, size * 2, np.uint64(int(power) ** 2 % 2**64)
    n = np.maximum(b - a - SHINGLE + 1, 1)
    first = np.r_[0, np.cumsum(n)]
    short = np.flatnonzero(b - a < SHINGLE)
    i = np.arange(first[-1]) - np.repeat(first[:-1] - a, n)
    out = mix(gram)[np.minimum(i, max(len(gram) - 1, 0))] if len(gram) else np.zeros(first[-1], np.uint64)
    out[first[short]] = _spans(raw, start[short], end[short])
    return out, first


def _bins(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """(stretches, width): half of a shingle's hash says its bin, the other half is its value there, and a bin keeps the least."""
    n = len(first) - 1
    at = ((hashes >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
    at += np.repeat(np.arange(n) * width, np.diff(first))
    out = np.full(n * width, EMPTY)
    np.minimum.at(out, at, hashes.astype(np.uint32))
    return out.reshape(n, width)


def _filled(out: np.ndarray) -> np.ndarray:
    """An empty bin takes the value of the next full one to its right (round), changed by how far that is, so that two sets still agree in a bin
    as often as they are alike."""
    width = out.shape[1]
    gaps = np.flatnonzero((out == EMPTY).any(axis=1))
    twice = np.concatenate([out[gaps]] * 2, axis=1)
    place = np.arange(2 * width, dtype=np.int32)
    full = np.where(twice != EMPTY, place, np.int32(2 * width - 1))
    near = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :width]
    out[gaps] = np.take_along_axis(twice, near, axis=1) + (near - place[:width]).astype(np.uint32) * np.uint32(0x9E3779B1)
    return out


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(stretches, BANDS * ROWS) of 32-bit values: MinHash by one permutation."""
    return _filled(_bins(hashes, first, BANDS * ROWS))


def _band_keys(filled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signatures -> (stretches, bands) of 64-bit band values. A band's bins lie apart, so that the neighbours that an empty bin is filled from are in other bands."""
    pairs = np.ascontiguousarray(filled.reshape(-1, rows, bands).transpose(0, 2, 1)).view(np.uint64)
    out = mix(pairs[..., 0] + np.arange(bands, dtype=np.uint64))
    for i in range(1, rows // 2):
        out = mix(out ^ mix(pairs[..., i] + np.uint64(i)))
    return out


def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(stretches, BANDS) of 64-bit band values."""
    return _band_keys(signatures(hashes, first), BANDS, ROWS)


def _packed(bits: np.ndarray) -> np.ndarray:
    """(stretches, up to 96) of 0 and 1 -> sketches, 12 bytes each."""
    out = np.zeros((len(bits), 96), np.uint8)
    out[:, : bits.shape[1]] = bits
    return np.packbits(out, axis=1, bitorder="little")


def _parities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each stretch PARITIES bits, how often its distinct shingles fall on each (odd or even), and above them how many it has (at most MANY).

    Two sets differ by at least as many shingles as they have different bits.
    """
    n = len(first) - 1
    if n >> 24:
        half = n // 2
        return np.r_[_parities(hashes[: first[half]], first[: half + 1]), _parities(hashes[first[half] :], first[half:] - first[half])]
    owned = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(40), np.diff(first)) | hashes >> np.uint64(24))
    owned = owned[np.r_[True, owned[1:] != owned[:-1]][: len(owned)]]
    fell = owned & np.uint64((1 << 40) - 1)
    whose = (owned >> np.uint64(40)).astype(np.int64)
    fell = np.bincount(whose * PARITIES + (fell % np.uint64(PARITIES)).astype(np.int64), minlength=n * PARITIES)
    out = _packed((fell & 1).reshape(n, PARITIES))
    out[:, 11] |= (np.minimum(np.bincount(whose, minlength=n), MANY) << 1).astype(np.uint8)
    return out


def posted_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band values of each stretch, by its own kind of bands or by both, the stretch that each is of, and its sketch.

    A band value is odd where it is of the long kind; the sketch is then one bit of each of 96 signature values, else parities.
    """
    bins = _bins(hashes, first, BANDS * ROWS)
    full = (bins != EMPTY).sum(axis=1)
    long, short = np.flatnonzero(full >= EITHER[0]), np.flatnonzero(full <= EITHER[1])
    size = np.diff(first)[short]
    start = np.r_[0, np.cumsum(size)]
    picked = hashes[np.arange(start[-1]) + np.repeat(first[short] - start[:-1], size)]
    signed = _filled(bins[long])
    a, b = _band_keys(signed, BANDS, ROWS), _band_keys(_filled(_bins(picked, start, SHORT[0] * SHORT[1])), *SHORT)
    keys = np.r_[a.ravel() | np.uint64(1), b.ravel() & ~np.uint64(1)]
    sketch = np.r_[np.repeat(_packed(signed[:, :96] >> np.uint32(9) & np.uint32(1)), BANDS, axis=0), np.repeat(_parities(picked, start), SHORT[0], axis=0)]
    return keys, np.r_[np.repeat(long, BANDS), np.repeat(short, SHORT[0])], sketch


def may_be_alike(odd: np.ndarray, sketch: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of places i and j, whether sketches leave it open that two lines are alike; of the short kind none that are alike are ruled out, of the long kind one in 10,000."""
    lower, upper = sketch[:, :8].copy().view(np.uint64).ravel(), sketch[:, 8:].copy().view(np.uint32).ravel()
    size = (upper >> np.uint32(PARITIES - 64)).astype(np.int64)
    own = np.where(odd, np.uint32(0xFFFFFFFF), np.uint32((1 << (PARITIES - 64)) - 1))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(lower[i] ^ lower[j]) + np.bitwise_count((upper[i] ^ upper[j]) & own[i])
        a, b = size[i], size[j]
        return np.where(odd[i], apart <= APART, (np.maximum(a, b) >= MANY) | (apart * (1 + SIMILARITY) <= (a + b) * (1 - SIMILARITY) + 1e-9))

    return near


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, at = utf8(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PORTION, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


#: A posting: a line, the low 40 bits of one of its band values, its sketch.
POSTING = np.dtype([("line", "<i8"), ("low", "<u4"), ("high", "u1"), ("sketch", "u1", 12)])


def banded(rows: DataFrame) -> DataFrame:
    """bucket, postings: the band values of every line's hash, with its sketch; a line that a task has just seen is left out.

    Postings are packed by ranges of band values, BUCKETS for each task of the shuffle, up to PACK in a row, so that the JVM moves few rows.
    """
    buckets = np.uint64(BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            keys, lines, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (keys >> np.uint64(32)) * buckets >> np.uint64(32)
            order = np.argsort(bucket)
            bucket = bucket[order]
            out = np.empty(len(order), POSTING)
            out["line"], out["sketch"], keys = lines[order], sketch[order], keys[order]
            out["low"], out["high"] = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint8)
            new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[new, len(bucket)])
            rows = -(-size // PACK)
            cuts = np.repeat(new, rows) + (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)) * PACK
            ends = np.r_[cuts, len(bucket)].astype(np.int32) * np.int32(POSTING.itemsize)
            blobs = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            return pa.record_batch([pa.array(bucket[cuts].view(np.int64)), blobs], ["bucket", "postings"])

        for batch in batches:
            if len(seen) > SEEN:
                seen = seen[:0]
            for _, _, raw, at in _portions(batch, 0):
                _, _, start, end = lines_of(raw, at)
                full = end > start
                line, i = np.unique(_spans(raw, start[full], end[full]), return_index=True)
                near = np.minimum(np.searchsorted(seen, line), max(len(seen) - 1, 0))
                new = seen[near] != line if len(seen) else np.ones(len(line), bool)
                seen = np.sort(np.r_[seen, line[new]])
                line, i = line[new], np.flatnonzero(full)[i[new]]
                if len(line):
                    keys, whose, sketch = posted_keys(*shingles(raw, start[i], end[i]))
                    held.append((keys, line[whose], sketch))
                    if sum(len(x[0]) for x in held) > HELD:
                        yield packed()
        if held:
            yield packed()

    return rows.select("text").mapInArrow(run, "bucket long, postings binary")


def _clusters(key: np.ndarray, line: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Groups (one after another, members distinct) -> smaller groups that hold every pair (of places, tested by `near`) that may be alike.

    A group is named by a hash of its members. Pairs are groups of two; a group of more than PAIRS pairs a member is taken apart into what chains of pairs join.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    small = np.repeat(size <= 8, size)
    a, b, keys, lines = [], [], [], []
    for d in range(1, 8):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        at = at[near(at, at + d)]
        a.append(line[at])
        b.append(line[at + d])
    for s, n in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        own = line[s : s + n]
        i, j = np.triu_indices(n, 1)
        hit = near(s + i, s + j)
        i, j = i[hit], j[hit]
        if len(i) <= PAIRS * n:
            a.append(own[i])
            b.append(own[j])
            continue
        linked, left = np.zeros((n, n), bool), np.ones(n, bool)
        linked[i, j] = linked[j, i] = True
        while left.any():
            found, new = np.zeros(n, bool), np.zeros(n, bool)
            new[np.argmax(left)] = True
            while new.any():
                found |= new
                new = linked[new].any(axis=0) & ~found
            left &= ~found
            if found.sum() > 1:
                members = np.sort(own[found])
                keys.append(np.repeat(_spans(members.view(np.uint64), np.array([0]), np.array([len(members)])).view(np.int64), len(members)))
                lines.append(members)
    a, b = np.concatenate(a), np.concatenate(b)
    low, high = np.minimum(a, b), np.maximum(a, b)
    pair = mix(mix(low.view(np.uint64)) + high.view(np.uint64)).view(np.int64)
    return np.concatenate([pair, pair, *keys]), np.concatenate([low, high, *lines])


def _by_sketch(key: np.ndarray, line: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _clusters(key, line, may_be_alike((key & 1).astype(bool), sketch))


def _by_signature(key: np.ndarray, line: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """signature: (lines, BANDS * ROWS / 2) bytes, two values' lowest half bytes in each; of short lines zeros, which are like any."""
    known = signature.any(axis=1)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = ~(known[i] & known[j])
        todo = np.flatnonzero(~out)
        for at in range(0, len(todo), 1 << 15):
            t = todo[at : at + (1 << 15)]
            apart = signature[i[t]] ^ signature[j[t]]
            out[t] = ((apart & 15) == 0).sum(axis=1) + (apart < 16).sum(axis=1) >= AGREE
        return out

    return _clusters(key, line, near)


def _half_bytes(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """Each stretch's signature as _by_signature reads it; none for those of the short kind."""
    bins = _bins(hashes, first, BANDS * ROWS)
    known = np.flatnonzero((bins != EMPTY).sum(axis=1) > EITHER[1])
    half = (_filled(bins[known]) >> np.uint32(9) & np.uint32(15)).astype(np.uint8)
    out: list[bytes | None] = [None] * len(bins)
    for i, x in zip(known.tolist(), half[:, ::2] << 4 | half[:, 1::2], strict=True):
        out[i] = x.tobytes()
    return out


def _streamed(taken_apart: Callable, last: Callable) -> Callable:
    """A function over batches sorted by key (key, line, a third column read by `last`) that gives whole groups to `taken_apart`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x) for x in taken_apart(*cols)], ["key", "line"])

        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), last(batch.column(2))]
            held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            if len(held[0]) and (cut := int(np.searchsorted(held[0], held[0][-1]))):
                yield out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield out(held)

    return run


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join([x or bytes(BANDS * ROWS // 2) for x in column.to_pylist()]), np.uint8).reshape(-1, BANDS * ROWS // 2)


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 12)


def _postings(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Packed rows -> each posting's bucket, band value (spread anew, its kind in the lowest bit), line and sketch."""
    packs = batch.column(1)
    at = np.frombuffer(packs.buffers()[1], np.int32)[packs.offset : packs.offset + len(packs) + 1].astype(np.int64) if len(packs) else np.zeros(1, np.int64)
    found = np.frombuffer(packs.buffers()[2], np.uint8)[at[0] : at[-1]].view(POSTING) if len(packs) else np.zeros(0, POSTING)
    bucket = np.repeat(batch.column(0).to_numpy(), np.diff(at) // POSTING.itemsize)
    key = found["low"].astype(np.uint64) | found["high"].astype(np.uint64) << np.uint64(32)
    kind = key & np.uint64(1)
    key = mix(key ^ mix(bucket.view(np.uint64))) & ~np.uint64(1) | kind
    return [bucket, key.view(np.int64), found["line"].copy(), found["sketch"].copy()]


def shared(bands: DataFrame) -> DataFrame:
    """bucket, postings -> key, line, sketch, whole: band values of several lines.

    Up to BLOCK lines are groups whose members may be alike (whole); of more, the rows are handed on as they are, whatever their number.
    """
    n = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["key", "line", "sketch", "whole"]

    def several(key: np.ndarray, line: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
        """Postings whose band value has several lines, each once, in order."""
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        many = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
        order, key = order[many], key[many]
        line = line[order]
        again = np.lexsort((line, key))
        key, line, order = key[again], line[again], order[again]
        new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])][: len(key)]
        key, line, order = key[new], line[new], order[new]
        same = key[1:] == key[:-1]
        many = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
        return [key[many], line[many], sketch[order[many]]]

    def raw(key: np.ndarray, line: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key), pa.array(line), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(np.zeros(len(key), bool))], names)

    def sized(key: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        return np.repeat(size, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # bucket, key, line, sketch
        count, limit = 0, HELD
        hot = np.zeros(0, np.int64)  # band values of more than BLOCK lines: their further rows are handed on

        def close(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cols = several(*cols[1:])
            big = sized(cols[0]) > BLOCK
            if big.any():
                yield raw(*(x[big] for x in cols))
            keys, lines = _by_sketch(*(x[~big] for x in cols))
            if len(keys):
                yield pa.record_batch([pa.array(keys), pa.array(lines), pa.nulls(len(keys), pa.binary()), pa.array(np.ones(len(keys), bool))], names)

        for batch in batches:
            cols = _postings(batch)
            if len(hot) and (known := np.isin(cols[1], hot)).any():
                yield raw(*(x[known] for x in cols[1:]))
                cols = [x[~known] for x in cols]
            held.append(cols)
            count += len(cols[0])
            if count < HELD:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            if cut := int(np.searchsorted(cols[0], cols[0][-1])):  # the last bucket may go on
                yield from close([x[:cut] for x in cols])
                cols, limit, hot = [x[cut:] for x in cols], HELD, hot[:0]
            elif count > 8 * limit:  # a large bucket: its large groups go on at once
                order = np.lexsort((cols[2], cols[1]))
                cols = [x[order] for x in cols]
                new = np.r_[True, (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]
                cols = [x[new] for x in cols]
                big = sized(cols[1]) > BLOCK
                if big.any():
                    yield raw(*(x[big] for x in cols[1:]))
                    hot = np.union1d(hot, cols[1][big])
                cols = [x[~big] for x in cols]
                limit = max(limit, len(cols[0]))
            held, count = [cols], len(cols[0])
        if held:
            yield from close([np.concatenate(x) for x in zip(*held, strict=True)])

    return bands.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, line long, sketch binary, whole boolean")


def candidates(rows: DataFrame) -> DataFrame:
    """key, line: groups of at most two blocks of lines, together holding every pair of lines that bands and sketches find."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checkpoint(shared(banded(rows)))
    groups = found.filter("whole").select("key", "line").distinct()
    large = found.filter("not whole").select("key", "line", "sketch").distinct()
    blocks = checkpoint(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows")))
    if not blocks.head(1):
        return groups
    # blocks are numbered by line alone, so that band values with the same members give the same groups
    block = F.pmod(F.xxhash64("line", F.lit(1)), F.col("blocks")).cast("int")
    dealt = spread_join(large, blocks, "key", "rows").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or block <> other")
    pair = F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).otherwise(F.xxhash64("key"))
    pair = pair.bitwiseAND(~1).bitwiseOR(F.col("key").bitwiseAND(1))  # still tells the kind

    dealt = dealt.select(pair.alias("key"), "line", "sketch").repartition(n, "key").sortWithinPartitions("key", "line")
    return groups.union(dealt.mapInArrow(_streamed(_by_sketch, _sketches_of), "key long, line long")).distinct()


def placed_lines(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """line (hash), place (id, number, rid of the first), n, said and signature (trimmed text and half bytes, of the wanted lines): the lines that are wanted or occur again."""
    shared_bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared_bits.value
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, raw, at in _portions(batch, 2):
                text, number, start, end = lines_of(raw, at)
                full = end > start
                text, number, start, end = text[full], number[full], start[full], end[full]
                line = _spans(raw, start, end)
                said, signature, body = [None] * len(line), [None] * len(line), raw.tobytes()
                named = np.flatnonzero(in_bitmap(bits, line))
                if len(i := np.sort(named[np.unique(line[named], return_index=True)[1]])):  # each text once
                    for i, x in zip(i.tolist(), _half_bytes(*shingles(raw, start[i], end[i])), strict=True):
                        said[i], signature[i] = body[start[i] : end[i]], x
                yield pa.record_batch([pa.array(line.view(np.int64)), pa.array(ids[lo:hi][text]), pa.array(number.astype(np.int32)), pa.array(rids[lo:hi][text]), pa.array(said, pa.binary()), pa.array(signature, pa.binary())], ["line", "id", "number", "rid", "said", "signature"])

    lines = rows.select("id", "rid", "text").mapInArrow(run, "line long, id long, number int, rid long, said binary, signature binary")
    lines = lines.groupBy("line").agg(F.min(F.struct("id", "number", "rid")).alias("place"), F.count(F.lit(1)).alias("n"), F.first("said", ignorenulls=True).alias("said"), F.first("signature", ignorenulls=True).alias("signature"))
    return lines.filter("n > 1 or said is not null")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILARITY or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SIMILARITY * len(b):
        return False
    common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def _alike_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Like `alike` for each pair of sorted sets of 50-bit values, in one merge of all."""
    if len(a) > 1 << 13:
        half = len(a) // 2
        return np.r_[_alike_pairs(a[:half], b[:half]), _alike_pairs(a[half:], b[half:])]
    if not a:
        return np.zeros(0, bool)
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    pair = np.arange(len(a), dtype=np.uint64) << np.uint64(50)
    both = np.concatenate([np.concatenate(x) | np.repeat(pair, n) for x, n in ((a, na), (b, nb))])
    both.sort(kind="stable")  # two sorted runs
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(50)).astype(np.int64), minlength=len(a))
    return common >= SIMILARITY * (na + nb - common) - 1e-9


def _forest(line: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what chains of similar lines join; a component's edges form a tree of fan FAN."""
    if len(line) == 2:
        return [(int(line.max()), int(line.min()))] if alike(*sets) else []
    order = np.argsort(line).tolist()
    edges = []
    while order:
        found, todo, order = [order[0]], [order[0]], order[1:]
        while todo and order:
            own = sets[todo.pop()]
            sizes = np.array([len(sets[i]) for i in order])
            near = np.flatnonzero((np.minimum(sizes, len(own)) >= SIMILARITY * np.maximum(sizes, len(own))))
            if len(near):
                flat = np.concatenate([sets[order[i]] for i in near])
                at = np.searchsorted(own, flat)
                common = np.add.reduceat(own[np.minimum(at, len(own) - 1)] == flat, np.r_[0, np.cumsum(sizes[near])[:-1]])
                near = near[common >= SIMILARITY * (sizes[near] + len(own) - common) - 1e-9]
                new = {order[i] for i in near.tolist()}
                todo += new
                found += new
                order = [i for i in order if i not in new]
        found = sorted(line[found].tolist())
        edges += [(found[i], found[(i - 1) // FAN]) for i in range(1, len(found))]
    return edges


def verified(groups: DataFrame) -> DataFrame:
    """key, line, said, dealt and sorted by key -> edges (a, b) of lines at SIMILARITY or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            key, line = t.column(0).to_numpy(), t.column(1).to_numpy()
            _, one, which = np.unique(line, return_index=True, return_inverse=True)  # a line may be in several groups
            said = t.column(2).take(pa.array(one)).to_pylist()
            at = np.r_[0, np.cumsum([len(x) for x in said])]
            hashes, first = shingles(np.frombuffer(b"".join(said), np.uint8), at[:-1], at[1:])
            whose = np.repeat(np.arange(len(said), dtype=np.uint64), np.diff(first))
            down = np.uint64(max(14, len(said).bit_length()))  # the other bits, 50 at most, of a shingle's hash lie under its line's number
            distinct = np.sort(whose << (np.uint64(64) - down) | hashes >> down)
            distinct = distinct[np.r_[True, distinct[1:] != distinct[:-1]][: len(distinct)]]
            cut = np.searchsorted(distinct, np.arange(len(said), dtype=np.uint64) << (np.uint64(64) - down)).tolist() + [len(distinct)]
            distinct &= np.uint64((1 << (64 - int(down))) - 1)
            own = [distinct[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            two = start[:-1][np.diff(start) == 2]
            edges = [(max(p), min(p)) for p in zip(line[two].tolist(), line[two + 1].tolist(), strict=True)]
            good = _alike_pairs([own[i] for i in which[two].tolist()], [own[i] for i in which[two + 1].tolist()])
            edges = [e for e, g in zip(edges, good.tolist(), strict=True) if g]
            for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                if b - a > 2:
                    edges += _forest(line[a:b], [own[i] for i in which[a:b].tolist()])
            e = np.array(edges, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = pa.Table.from_batches([batch.slice(at, 2048)])
                held = part if held is None else pa.concat_tables([held, part])
                key = held.column(0).to_numpy()
                if cut := int(np.searchsorted(key, key[-1])):
                    yield out(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield out(held)

    return groups.mapInArrow(run, "a long, b long")


def numbered(rows: DataFrame) -> DataFrame:
    """Every line of every text: id, rid, number, line (hash; null where blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, raw, at in _portions(batch, 2):
                text, number, start, end = lines_of(raw, at)
                line = pa.array(_spans(raw, start, end).view(np.int64), mask=end == start)
                yield pa.record_batch([pa.array(ids[lo:hi][text]), pa.array(rids[lo:hi][text]), pa.array(number.astype(np.int32)), line], ["id", "rid", "number", "line"])

    return rows.select("id", "rid", "text").mapInArrow(run, "id long, rid long, number int, line long")


def moved_lines(rows: DataFrame) -> DataFrame:
    """keyed rows -> line, stays (the place of the line that stays for it), n (its places): the lines of components of several places."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = checkpoint(candidates(rows), free=True)
    lines = checkpoint(placed_lines(rows, groups.select("line")), free=True)
    texts = lines.filter("said is not null")
    signed = groups.join(texts.select("line", "signature"), "line").select("key", "line", "signature").repartition(n, "key").sortWithinPartitions("key", "line")
    groups = signed.mapInArrow(_streamed(_by_signature, _signatures_of), "key long, line long").distinct()
    groups = groups.join(texts.select("line", "said"), "line").select("key", "line", "said")
    edges = checkpoint(verified(groups.repartition(n, "key").sortWithinPartitions("key")).distinct())
    roots = components(edges)
    labelled = lines.join(roots, lines["line"] == roots["v"], "left").select("line", "place", "n", F.coalesce("root", "line").alias("root"))
    stays = labelled.groupBy("root").agg(F.min("place").alias("stays"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("members")).filter(F.col("all") > 1)
    return checkpoint(spread_join(labelled.select("line", "n", "root"), stays.select("root", "stays", "members"), "root", "members").select("line", "stays", "n"))


def line_classes(docs: DataFrame) -> DataFrame:
    """id, rid, number, and the place of the line that stays for it (keep_id, keep_rid, keep_number): one row for each line."""
    rows = keyed(docs)
    out = spread_join(numbered(rows), moved_lines(rows), "line", "n", "left")
    keep = F.coalesce("stays", F.struct("id", "number", "rid"))
    return out.select("id", "rid", "number", keep["id"].alias("keep_id"), keep["rid"].alias("keep_rid"), keep["number"].alias("keep_number"))


def _stays():
    return (F.col("id") == F.col("keep_id")) & (F.col("rid") == F.col("keep_rid")) & (F.col("number") == F.col("keep_number"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, keeper_doc_id, keeper_line_no, kept: one row for each line of each text (equal rows: for each of them)."""
    found = line_classes(docs)
    back = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return found.select(back("id").alias("doc_id"), F.col("number").alias("line_no"), back("keep_id").alias("keeper_doc_id"), F.col("keep_number").alias("keeper_line_no"), _stays().alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that don't stay taken out of text (and n_chars, where there is such a column, counted anew)."""
    gone, gone_id, gone_rid, said = (unused(docs, x) for x in ("gone", "gone_id", "gone_rid", "said"))
    found = line_classes(docs).filter(~_stays()).groupBy("id", "rid").agg(F.collect_set("number").alias(gone))
    found = checkpoint(found.withColumnRenamed("id", gone_id).withColumnRenamed("rid", gone_rid))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    text = F.coalesce(docs["text"], F.lit(""))
    rid = F.xxhash64(docs["doc_id"].cast("long"), text)
    both = docs.join(found, (key == found[gone_id]) & (rid == found[gone_rid]), "left")
    changed = F.col(gone).isNotNull()
    # split once, in a projection of its own: inside transform it would be split anew for each line
    both = both.withColumn(said, F.when(changed, F.split(F.col("text"), "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(said) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(said), i)), "\n")
    both = both.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)
