"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits differ in at most four bytes, so
they share at least four of the eight positional bytes: that is the guaranteed minimum of matches. Postings of single bytes
would be 1/256 of all fingerprints, so the index posts combinations of three positional bytes: the twenty triples of TRIPLES
meet every choice of four positions (a Turan covering), hence every pair with four matches shares a posting. In a posting the
shared positional bytes of each pair are tallied over all eight positions, pairs under the minimum are dropped, and only those that are left are
verified on all 64 bits.

A posting of near-equal fingerprints would yield a number of pairs that grows with its square. Postings therefore return a
spanning forest of their links (search over the members not yet reached), which joins exactly what all pairs would join;
postings over BLOCK members are split into pairs of blocks, each a task's work of its own. Equal fingerprints are one vertex.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts with fewer than four words are one
shingle; very long texts are hashed whole, in memory of some 60 bytes for each of theirs; a bit set in exactly half of the shingles is zero; repeated rows share a component; a row with a null doc_id is returned with the component of its fingerprint's class,
whose id is the least doc_id that is not null (null where there is none); no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import checkpoint, id_text, small_batches, spread_join, unused
from cairn.llm.components import components

BITS = 4
LEAST_MATCHES = 8 - BITS
BLOCK = 2048
FAN = 32
#: Postings up to this are searched pair by pair, all pairs at once.
PAIRED = 256


def _triples() -> list[tuple[int, int, int]]:
    """Turan's construction for 8 points: parts 0-2, 3-5, 6-7 in a ring; the triples inside a part, and two of a part with one of the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [p for p in parts if len(p) == 3]
    for p, following in zip(parts, [*parts[1:], parts[0]], strict=True):
        out += [(x, y, z) for i, x in enumerate(p) for y in p[i + 1 :] for z in following]
    return [tuple(sorted(t)) for t in out]


TRIPLES = _triples()


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 (seed 42) of each four-word shingle of a lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), len(words)
    if n <= 4:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - 3].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts, ends[3:].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; zero without words."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and further columns -> doc_id, fp and those."""
    for b in batches:
        fps = np.array([fingerprint(x.as_buffer().to_pybytes()) for x in b.column(1).cast(pa.binary())], np.uint64)
        yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return id_text(docs).mapInArrow(_run, "doc_id long, fp long")


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def postings(fps: DataFrame) -> DataFrame:
    """fp -> (posting, fp): the posting's number above the three bytes."""
    keys = [F.lit(k << 24).cast("long") + _byte(x) * 65536 + _byte(y) * 256 + _byte(z) for k, (x, y, z) in enumerate(TRIPLES)]
    return fps.select(F.explode(F.array(*keys)).alias("posting"), "fp")


_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def tally(apart: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes two fingerprints share, of the bits in which they differ: a shared byte is zero there."""
    return np.bitwise_count(~(((apart & _LOW) + _LOW) | apart | _LOW))


def linked(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Where pairs are links: counted first, and verified only where the count reaches the minimum."""
    apart = a ^ b
    out = tally(apart) >= LEAST_MATCHES
    out[out] = np.bitwise_count(apart[out]) <= BITS
    return out


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join exactly the members of one posting that chains of links join; a component's edges form a tree of fan FAN."""
    left, edges = np.sort(fps), []
    while len(left):
        found, todo, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            near = linked(left, todo.pop())
            todo += (new := left[near].tolist())
            found += new
            left = left[~near]
        found = np.sort(np.array(found, np.uint64))
        edges += [(int(found[i]), int(found[(i - 1) // FAN])) for i in range(1, len(found))]
    return edges


def _links_of(fps: np.ndarray) -> np.ndarray:
    """Edges of one posting: its linked pairs where these are few, else its forest."""
    if len(fps) <= PAIRED:
        i, j = np.triu_indices(len(fps), 1)
        near = linked(fps[j], fps[i])
        if near.sum() <= 2 * len(fps):
            return np.stack([fps[j[near]], fps[i[near]]], axis=1)
    return np.array(_forest(fps), np.uint64).reshape(-1, 2)


def links(posted: DataFrame) -> DataFrame:
    """(key..., fp) dealt by key and sorted -> edges (a, b) between fingerprints that differ in at most BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """Short postings: pairs at each distance along the sorted run; longer ones each by itself."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.r_[starts, len(keys)])
            short, found = np.repeat(size <= 8, size), []
            for d in range(1, 8):
                at = np.flatnonzero((keys[d:] == keys[:-d]) & short[d:])
                at = at[linked(fps[at + d], fps[at])]
                found.append(np.stack([fps[at + d], fps[at]], axis=1))
            found += [_links_of(fps[s : s + n]) for s, n in zip(starts[size > 8].tolist(), size[size > 8].tolist(), strict=True)]
            e = np.concatenate(found)
            e = np.unique(e[e[:, 0] != e[:, 1]], axis=0)
            return pa.record_batch([pa.array(e[:, 0].copy().view(np.int64)), pa.array(e[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) and keys[0] != keys[-1]:  # the last posting may go on in the next batch
                cut = int(np.searchsorted(keys, keys[-1]))
                yield out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield out(keys, fps)

    return posted.mapInArrow(run, "a long, b long")


def link_edges(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> a forest of links whose components are those of all links."""
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = postings(fps)
    hot = posted.groupBy("posting").count().filter(F.col("count") > BLOCK).select("posting", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = checkpoint(hot)
    blocks = F.coalesce("blocks", F.lit(1))
    rows = posted.join(hot, "posting", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a block alone is part of its pair with any other, so the pair with itself is needed only where there is one block
    rows = rows.filter("blocks = 1 or block <> other")
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    rows = rows.select((F.col("posting") * 1048576 + pair).alias("key"), "fp")
    return links(rows.repartition(n, "key").sortWithinPartitions("key"))


def _rooted(rows: DataFrame) -> DataFrame:
    """doc_id, fp -> fp, rows (with it), least (doc_id of the fingerprint), root (the component): one row for each fingerprint."""
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    edges = checkpoint(link_edges(classes.select("fp")))
    roots = components(edges)
    return classes.join(roots, classes["fp"] == roots["v"], "left").select("fp", "rows", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links of at most BITS bits."""
    rows = checkpoint(fingerprints(docs))
    rooted = checkpoint(_rooted(rows))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = spread_join(rooted.select("fp", "rows", "root"), least, "root", "members").select("fp", "rows", "component_id")
    out = spread_join(rows, named, "fp", "rows")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_hash(docs: DataFrame):
    """A hash of the whole row that tells which of its columns are null."""
    return F.xxhash64(*(docs[c] for c in docs.columns), *(docs[c].isNull() for c in docs.columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs (all columns) for each component: the one of least doc_id, nulls last; of rows that share it, the one of least row hash.

    Rows are dealt by component, not by doc_id, so every component of null ids keeps a row, and no row that stays is a near copy of another.
    An id stays once: where several components would keep rows of one id (different texts under it), the row of least hash stays and the
    other components have none. Of rows equal in all columns one stays; only those are shuffled with their texts for that.
    """
    small_batches(docs.sparkSession)
    rid, times = unused(docs, "rid"), unused(docs, "times")
    asked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), _row_hash(docs).alias("rid"))
    rows = checkpoint(asked.mapInArrow(_run, "doc_id long, fp long, rid long"))
    roots = checkpoint(_rooted(rows)).select("fp", "root", F.col("rows").alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    counted = rows.groupBy("doc_id", "fp", "rid").agg(F.count(F.lit(1)).alias("rows"))
    counted = spread_join(counted, roots, "fp", "times")
    kept = counted.groupBy("root").agg(F.min_by(F.struct("doc_id", "rid", "rows"), place).alias("kept")).select("root", "kept.*")
    # an id that is null is nobody's: those rows are told apart by their component
    kept = kept.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("root")).alias("own")).agg(F.min_by(F.struct("rid", "rows"), "rid").alias("kept"))
    kept = checkpoint(kept.select(F.col("kept.rid").alias(rid), F.col("kept.rows").alias(times)))
    once = docs.join(kept.filter(F.col(times) == 1), _row_hash(docs) == kept[rid], "left_semi")
    again = docs.join(kept.filter(F.col(times) > 1), _row_hash(docs) == kept[rid], "left_semi")
    first = again.groupBy(_row_hash(again).alias(rid)).agg(F.first(F.struct(*again.columns)).alias(times))
    return once.unionByName(first.select(f"{times}.*"))
