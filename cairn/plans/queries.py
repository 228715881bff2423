"""Named queries over the driver tables, and the SQL that gives the same rows.

The store's tables are read out of the driver's: lineitem is the log of block writes (inode l_orderkey, block l_linenumber, hash
l_partkey, size l_quantity), orders are inodes, part holds each hash's sizes and codec (p_brand), nations are subvolumes, documents are files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.functions import access, binary, text
from cairn.operators import blocks, codecs, gc, integrity, namespace, snapshots, usage
from cairn.sources.readers import table
from cairn.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
B = 1024
NOW, PLAN = "2001-08-01 12:00:00", snapshots.Plan(14, 8, 6, 2)
ROOT_NATION = 0
DISK = 123_456_789


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return add


# ---- the store's tables


def long(c: str) -> Column:
    return F.floor(c).cast("long")


def write_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("inode_id"), F.col("l_linenumber").alias("block_number"), "l_shipdate", F.col("l_partkey").alias("hash_id"), "l_suppkey", long("l_quantity").alias("real_size"), "l_extendedprice")


def index(spark: SparkSession, d: str) -> DataFrame:
    """The last write of every (inode, block)."""
    return blocks.last_write(write_log(spark, d), ["inode_id", "block_number"], ["l_shipdate", "hash_id", "l_suppkey", "real_size", "l_extendedprice"]).select("inode_id", "block_number", "hash_id", "real_size", "l_suppkey")


def inodes(spark: SparkSession, d: str) -> DataFrame:
    """orders as inodes; an order that is through (F) has no links. Its size is its price."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("long").alias("nlinks"), long("o_totalprice").alias("size"), "o_custkey", F.col("o_orderpriority").alias("priority"))


def subvolume_of_inode(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("subvol"))
    return inodes(spark, d).join(nation, "o_custkey").select("subvol", "id", "nlinks", "size")


def nation_index(spark: SparkSession, d: str) -> DataFrame:
    own = subvolume_of_inode(spark, d).select("subvol", F.col("id").alias("inode_id"))
    return index(spark, d).join(own, "inode_id").select("subvol", "inode_id", "block_number", "hash_id", "real_size")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("hash_id"), long("p_retailprice").alias("writed_size"), (F.col("p_size").cast("long") * 10).alias("compressed_size"))


def types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("hash_id"), F.col("p_brand").alias("codec"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def document_blocks(spark: SparkSession, d: str, padded: bool = False) -> DataFrame:
    return blocks.cut(files(spark, d), B, padded=padded)


LOG = """log AS (SELECT l_orderkey AS inode_id, l_linenumber AS block_number, l_partkey AS hash_id, CAST(floor(l_quantity) AS BIGINT) AS real_size, l_suppkey, l_shipdate, l_extendedprice FROM lineitem)"""
INDEX = (
    LOG
    + """, idx AS (SELECT inode_id, block_number, hash_id, real_size, l_suppkey FROM log
  QUALIFY row_number() OVER (PARTITION BY inode_id, block_number ORDER BY l_shipdate DESC, hash_id DESC, l_suppkey DESC, real_size DESC, l_extendedprice DESC) = 1)"""
)
INODES = """inodes AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS nlinks, CAST(floor(o_totalprice) AS BIGINT) AS size, c_nationkey AS subvol, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey)"""
SIZES = """sizes AS (SELECT p_partkey AS hash_id, CAST(floor(p_retailprice) AS BIGINT) AS writed_size, CAST(p_size AS BIGINT) * 10 AS compressed_size, p_brand AS codec FROM part)"""
NATION_INDEX = f"{INDEX}, {INODES}, nidx AS (SELECT subvol, inode_id, block_number, hash_id, real_size FROM idx JOIN inodes ON inode_id = id)"
CHUNKS = f"""files AS (SELECT doc_id, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, lang, i AS block_number, substring(h, CAST(i * {2 * B} + 1 AS BIGINT), {2 * B}) AS x FROM files, unnest(range(CAST(ceil(length(h) / {2.0 * B}) AS BIGINT))) AS t(i)),
blocks AS (SELECT doc_id, lang, block_number, CAST(length(x) / 2 AS BIGINT) AS real_size, md5(unhex(x)) AS digest FROM chunks)"""


# ---- blocks


@query(f"{CHUNKS} SELECT doc_id, block_number, real_size, real_size AS writed_size, digest FROM blocks")
def blocks_chunk_hash(spark, d):
    out = document_blocks(spark, d, padded=True).drop("real_size")
    return out.withColumn("real_size", F.col("writed_size")).select("doc_id", "block_number", "real_size", "writed_size", "digest")


@query(f"{CHUNKS} SELECT digest, doc_id, block_number, real_size AS writed_size, refs FROM (SELECT *, count(*) OVER (PARTITION BY digest) AS refs, row_number() OVER (PARTITION BY digest ORDER BY doc_id, block_number) AS n FROM blocks) WHERE n = 1")
def blocks_first_occurrence(spark, d):
    own = document_blocks(spark, d).select("digest", "doc_id", "block_number", "writed_size")
    return blocks.first_occurrence(own, ["doc_id", "block_number"])


@query(f"{CHUNKS}, new AS (SELECT digest, min((doc_id, block_number)) AS f FROM blocks WHERE lang <> 'en' GROUP BY 1) SELECT digest, f[1] AS doc_id, f[2] AS block_number FROM new WHERE digest NOT IN (SELECT digest FROM blocks WHERE lang = 'en')".replace("min((doc_id, block_number))", "min([doc_id, block_number])"))
def blocks_dedup_write(spark, d):
    own = document_blocks(spark, d).select("digest", "doc_id", "block_number", "lang")
    found = blocks.new_blocks(own.filter("lang <> 'en'").drop("lang"), own.filter("lang = 'en'"), ["doc_id", "block_number"])
    return found.select("digest", "doc_id", "block_number")


@query(f"{CHUNKS} SELECT count(DISTINCT digest) AS digests, (SELECT count(*) FROM (SELECT 1 FROM blocks GROUP BY substring(digest, 1, 3) HAVING count(DISTINCT digest) > 1)) AS collided FROM blocks")
def blocks_collision_check(spark, d):
    own = document_blocks(spark, d)
    short = own.select(F.substring("digest", 1, 3).alias("digest"), "stored")  # so few digits that there are collisions
    every = own.agg(F.count_distinct("digest").alias("digests"))
    return every.crossJoin(F.broadcast(blocks.collisions(short).agg(F.count(F.lit(1)).alias("collided"))))  # one row each


@query(f"{INDEX} SELECT inode_id, block_number, hash_id, real_size FROM idx")
def index_last_write_wins(spark, d):
    return index(spark, d).drop("l_suppkey")


@query(f"{CHUNKS}, w AS (SELECT doc_id, substring(h, 1001, 3000) AS x FROM files WHERE length(h) > 1000) SELECT doc_id, md5(unhex(x)) AS digest, CAST(length(x) / 2 AS BIGINT) AS size FROM w")
def index_range_read(spark, d):
    """Bytes 500 to 2000 of every file, by its index rows and the blocks that are stored once for each digest."""
    own = document_blocks(spark, d)
    stored = own.select("digest", "stored").dropDuplicates(["digest"])
    whole = files(spark, d).select("doc_id", F.octet_length("data").cast("long").alias("size"))
    rows = own.select("doc_id", "block_number", "digest").filter("block_number < 2").join(stored, "digest").join(whole, "doc_id")
    got = blocks.read_range(rows, "doc_id", "block_number", "stored", B, F.lit(500), F.lit(1500), F.col("size")).filter(F.octet_length("data") > 0)
    return got.select("doc_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


@query(f"files AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents) SELECT doc_id, substring(h, 2001, 4000) AS data FROM files WHERE length(h) > 2000")
def blocks_byte_range(spark, d):
    """Bytes 1000 to 3000 of every file, put together from its blocks."""
    own = document_blocks(spark, d)
    whole = files(spark, d).select("doc_id", F.octet_length("data").cast("long").alias("size"))
    rows = own.join(whole, "doc_id")
    got = blocks.read_range(rows, "doc_id", "block_number", "stored", B, F.lit(1000), F.lit(2000), F.col("size"))
    return got.select("doc_id", F.hex("data").alias("data")).filter("data <> ''")


@query(f"{INDEX}, {INODES} SELECT inode_id, block_number, hash_id FROM idx JOIN inodes ON inode_id = id WHERE block_number <= floor((size % 400) / 100)")
def index_truncate(spark, d):
    bounds = inodes(spark, d).select(F.col("id").alias("inode_id"), (F.col("size") % 400).alias("size"))
    return blocks.truncated(index(spark, d), bounds, "inode_id", "block_number", 100).select("inode_id", "block_number", "hash_id")


@query(f"{SIZES} SELECT CAST(hash_id % 10 AS INTEGER) AS part, count(*) AS blocks, CAST(sum(compressed_size) AS BIGINT) AS bytes FROM sizes GROUP BY 1")
def partition_modulo_layout(spark, d):
    return sizes(spark, d).groupBy(binary.partition_of(F.col("hash_id"), 10).alias("part")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("compressed_size").alias("bytes"))


@query(f"{CHUNKS} SELECT DISTINCT digest, concat_ws('/', substring(digest, 1, 4), substring(digest, 5, 4), substring(digest, 9, 4), substring(digest, 13, 4), digest) AS path FROM blocks")
def block_file_paths(spark, d):
    return document_blocks(spark, d).select("digest").distinct().withColumn("path", binary.digest_path(F.col("digest")))


# ---- usage


@query(f"""{CHUNKS}, u AS (SELECT lang, digest, min(real_size) AS s, count(*) AS n FROM blocks GROUP BY ALL)
SELECT lang, CAST(sum(s * n) AS BIGINT) AS apparent_size, CAST(sum(s * n) AS BIGINT) AS data_size, CAST(sum(s) AS BIGINT) AS unique_size, CAST(sum(s * n) - sum(s) AS BIGINT) AS dedup_size,
CAST(0 AS BIGINT) AS sparse_size, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS unique_blocks FROM u GROUP BY 1""")
def store_usage_by_subvolume(spark, d):
    own = document_blocks(spark, d, padded=True)
    refs = own.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("writed_size").alias("s"))
    data = refs.groupBy("lang").agg(usage.total(F.col("s") * F.col("n"), "data_size"), usage.total("s", "unique_size"), usage.total("n", "blocks"), F.count(F.lit(1)).alias("unique_blocks"))
    apparent = files(spark, d).filter(F.octet_length("data") > 0).groupBy("lang").agg(usage.total(F.octet_length("data").cast("long"), "apparent_size"))
    out = data.join(apparent, "lang")
    return out.select("lang", "apparent_size", "data_size", "unique_size", (F.col("data_size") - F.col("unique_size")).alias("dedup_size"), (F.col("apparent_size") - F.col("data_size")).alias("sparse_size"), "blocks", "unique_blocks")


USAGE = f"""{NATION_INDEX}, {SIZES}, r AS (SELECT subvol, hash_id, count(*) AS n FROM nidx GROUP BY ALL),
u AS (SELECT subvol, CAST(sum(writed_size * n) AS BIGINT) AS data_size, CAST(sum(writed_size) AS BIGINT) AS unique_size, CAST(sum(compressed_size * n) AS BIGINT) AS compressed_size, CAST(sum(compressed_size) AS BIGINT) AS compressed_unique_size, CAST(sum(n) AS BIGINT) AS blocks, count(*) AS unique_blocks FROM r JOIN sizes USING (hash_id) GROUP BY 1),
a AS (SELECT subvol, CAST(sum(size) AS BIGINT) AS apparent_size FROM inodes WHERE id IN (SELECT inode_id FROM idx) GROUP BY 1),
usage AS (SELECT subvol, data_size, unique_size, compressed_size, compressed_unique_size, blocks, unique_blocks, apparent_size, data_size - unique_size AS dedup_size, apparent_size - data_size AS sparse_size FROM u JOIN a USING (subvol))"""


def nation_usage(spark, d):
    return usage.usage(nation_index(spark, d), subvolume_of_inode(spark, d), sizes(spark, d))


@query(f"{USAGE} SELECT * FROM usage")
def store_usage_by_nation(spark, d):
    return nation_usage(spark, d)


@query(f"""{USAGE} SELECT subvol, apparent_size, data_size, unique_size, compressed_size, compressed_unique_size, round(compressed_size * 100.0 / apparent_size, 4) AS compressed_pct, round(compressed_unique_size * 100.0 / unique_size, 4) AS compressed_unique_pct,
round(dedup_size * 100.0 / data_size, 4) AS dedup_pct, round(sparse_size * 100.0 / apparent_size, 4) AS sparse_pct FROM usage""")
def store_usage_report(spark, d):
    return usage.usage_report(nation_usage(spark, d))


@query(f"{INDEX}, {INODES} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS apparent_size FROM inodes WHERE nlinks > 0 AND id IN (SELECT inode_id FROM idx)")
def apparent_size_tree_checked(spark, d):
    return usage.apparent_checked(inodes(spark, d), index(spark, d))


@query(f"{INODES} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS apparent_size FROM inodes WHERE nlinks > 0")
def apparent_size_fast(spark, d):
    return usage.apparent_fast(inodes(spark, d))


DIFF = f"""{NATION_INDEX}, diff AS (SELECT subvol, CAST(count(*) FILTER (WHERE hash_id NOT IN (SELECT hash_id FROM nidx WHERE subvol = {ROOT_NATION}) AND subvol <> {ROOT_NATION}) AS BIGINT) AS diff_blocks,
CAST(coalesce(sum(real_size) FILTER (WHERE hash_id NOT IN (SELECT hash_id FROM nidx WHERE subvol = {ROOT_NATION}) AND subvol <> {ROOT_NATION}), 0) AS BIGINT) AS diff_real_size FROM nidx GROUP BY 1)"""


@query(f"{DIFF} SELECT * FROM diff")
def root_diff(spark, d):
    return usage.root_diff(nation_index(spark, d), ROOT_NATION)


@query(f"""{DIFF}, a AS (SELECT subvol, CAST(sum(size) AS BIGINT) AS apparent_size FROM inodes WHERE nlinks > 0 GROUP BY 1)
SELECT n_name AS name, n_nationkey % 2 = 0 AS readonly, coalesce(apparent_size, 0) AS apparent_size, coalesce(CAST(diff_real_size AS VARCHAR), '---') AS diff_real_size, coalesce(CAST(diff_blocks AS VARCHAR), '---') AS diff_blocks,
strftime(TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created, CASE WHEN n_nationkey % 3 = 0 THEN 'not mounted' ELSE '2024-02-01 00:00:00' END AS mounted, 'not updated' AS updated
FROM nation LEFT JOIN a ON a.subvol = n_nationkey LEFT JOIN diff ON diff.subvol = n_nationkey""")
def subvolume_listing(spark, d):
    key = F.col("n_nationkey")
    subvolumes = table(spark, d, "nation").select(
        F.col("n_name").alias("name"), key.alias("subvol"), (key % 2 == 0).alias("readonly"),
        F.timestamp_seconds(F.lit(1704067200) + key * 86400).alias("created_at"),
        F.when(key % 3 != 0, F.timestamp_seconds(F.lit(1706745600))).alias("mounted_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )
    ids = subvolumes.select("subvol", "name")
    apparent = subvolume_of_inode(spark, d).filter("nlinks > 0").groupBy("subvol").agg(usage.total("size", "apparent_size")).join(ids, "subvol").drop("subvol")
    diff = usage.root_diff(nation_index(spark, d), ROOT_NATION).join(ids, "subvol").drop("subvol")
    return usage.listing(subvolumes.drop("subvol"), apparent, diff)


@query(f"""{INDEX}, {INODES}, {SIZES}, r AS (SELECT hash_id, count(*) AS n FROM idx GROUP BY 1),
u AS (SELECT CAST(sum(writed_size * n) AS BIGINT) AS data_size, CAST(sum(writed_size) AS BIGINT) AS unique_size, CAST(sum(compressed_size) AS BIGINT) AS compressed_unique_size FROM r JOIN sizes USING (hash_id)),
a AS (SELECT CAST(sum(size) AS BIGINT) AS apparent_size FROM inodes WHERE nlinks > 0)
SELECT apparent_size, data_size, unique_size, compressed_unique_size, CAST({DISK} AS BIGINT) AS disk_size, round((data_size - unique_size) * 100.0 / data_size, 4) AS dedup_pct, round((apparent_size - data_size) * 100.0 / apparent_size, 4) AS sparse_pct,
round((unique_size - compressed_unique_size) * 100.0 / unique_size, 4) AS saved_pct, round(({DISK} - compressed_unique_size) * 100.0 / compressed_unique_size, 4) AS overhead_pct FROM u, a""")
def store_disk_report(spark, d):
    return usage.disk_report(index(spark, d), inodes(spark, d), sizes(spark, d), DISK)


@query(f"{INDEX}, {SIZES}, c AS (SELECT codec, count(*) AS cnt FROM idx JOIN sizes USING (hash_id) GROUP BY 1) SELECT codec, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS pct FROM c")
def codec_histogram_rows(spark, d):
    return usage.codec_rows(index(spark, d), types(spark, d))


@query(f"{INDEX}, {SIZES}, c AS (SELECT codec, count(DISTINCT hash_id) AS cnt FROM idx JOIN sizes USING (hash_id) GROUP BY 1) SELECT codec, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 4) AS pct FROM c")
def codec_histogram_unique(spark, d):
    return usage.codec_unique(index(spark, d), types(spark, d))


@query(f"{INDEX} SELECT hash_id, count(*) AS refs FROM idx GROUP BY 1")
def hash_refcounts_live(spark, d):
    return usage.refcounts(index(spark, d))


@query(f"{INDEX}, l AS (SELECT hash_id, count(*) AS n FROM idx GROUP BY 1) SELECT hash_id, count(*) AS write_refs, coalesce(any_value(n), 0) AS live_refs FROM log LEFT JOIN l USING (hash_id) GROUP BY 1")
def hash_refcounts_writes(spark, d):
    return usage.write_refcounts(write_log(spark, d), index(spark, d))


DEAD = f"{INDEX}, {INODES}, live AS (SELECT idx.* FROM idx JOIN inodes ON id = inode_id WHERE nlinks > 0 AND priority = '1-URGENT')"


LIVE = "nlinks > 0 and priority = '1-URGENT'"


def live_index(spark, d):
    """Index rows of the linked inodes that are urgent; the others' files are gone, so that there are hashes without any."""
    return gc.alive(index(spark, d), inodes(spark, d).filter(LIVE), "inode_id", "id")


@query(f"{DEAD} SELECT hash_id FROM (SELECT hash_id, 1 AS delta FROM idx UNION ALL SELECT idx.hash_id, -1 FROM idx JOIN inodes ON id = inode_id WHERE nlinks = 0 OR priority <> '1-URGENT') GROUP BY 1 HAVING sum(delta) <= 0")
def unused_hashes(spark, d):
    own = index(spark, d)
    gone = gc.alive(own, inodes(spark, d).filter(f"not ({LIVE})"), "inode_id", "id")
    return gc.unused_by_count(own.select("hash_id", F.lit(1).alias("delta")).unionByName(gone.select("hash_id", F.lit(-1).alias("delta"))))


@query(f"{SIZES}, t AS (SELECT CAST(median(compressed_size) AS DOUBLE) AS median_size, round(avg(compressed_size), 4) AS mean_size FROM sizes) SELECT median_size, mean_size, CAST(least(greatest(pow(2, ceil(log2(greatest(median_size, 1)))), 512), 65536) AS BIGINT) AS page_size FROM t")
def typical_block_size(spark, d):
    return usage.typical_sizes(sizes(spark, d))


@query(f"{CHUNKS}, b AS (SELECT DISTINCT digest, real_size AS compressed_size FROM blocks), t AS (SELECT CAST(median(compressed_size) AS DOUBLE) AS median_size, round(avg(compressed_size), 4) AS mean_size FROM b) SELECT median_size, mean_size, CAST(least(greatest(pow(2, ceil(log2(greatest(median_size, 1)))), 512), 65536) AS BIGINT) AS page_size FROM t")
def typical_document_block_size(spark, d):
    return usage.typical_sizes(document_blocks(spark, d).select("digest", F.col("writed_size").alias("compressed_size")).distinct())


@query(f"{INODES} SELECT CAST(ceil(sum(CASE WHEN nlinks > 0 THEN size ELSE 0 END) / 65536.0) AS BIGINT) AS blocks, CAST(ceil(1000000007 / 65536.0) AS BIGINT) AS bavail, count(*) AS files, CAST(65536 AS BIGINT) AS bsize, CAST(65000 AS BIGINT) AS namemax FROM inodes")
def statfs(spark, d):
    return usage.statfs(inodes(spark, d), 65536, 1_000_000_007)


@query("""o AS (SELECT event_type AS op, CAST(floor(value * 100) AS BIGINT) AS bytes, CAST(user_id % 7 AS DOUBLE) AS seconds FROM events),
g AS (SELECT op, count(*) AS cnt, sum(seconds) AS seconds, CAST(sum(bytes) AS BIGINT) AS bytes FROM o GROUP BY 1), p AS (SELECT *, seconds * 100.0 / sum(seconds) OVER () AS t FROM g)
SELECT op, cnt, seconds, bytes, round(bytes / greatest(seconds, 1.0), 4) AS bytes_per_second, 50.0 AS saved_pct, round(t, 4) AS time_pct FROM p WHERE t >= 0.1""".replace("50.0 AS", "CAST(50 AS DOUBLE) AS"))
def operation_throughput(spark, d):
    bytes_ = long("value") * 0 + F.floor(F.col("value") * 100).cast("long")
    ops = table(spark, d, "events").select(F.col("event_type").alias("op"), bytes_.alias("bytes"), (F.col("user_id") % 7).cast("double").alias("seconds"), F.lit(2).cast("long").alias("written"), F.lit(1).cast("long").alias("compressed"))
    return usage.throughput(ops)


# ---- garbage and integrity


@query("""n AS (SELECT DISTINCT unnest(string_split(url, '/')) AS name FROM pages), live AS (SELECT DISTINCT unnest(string_split(url, '/')) AS name FROM pages WHERE length(html) > 2000)
SELECT md5(name) AS hash, name AS value FROM n WHERE name NOT IN (SELECT name FROM live)""")
def gc_names(spark, d):
    """Names of pages of which no page with much to it has a part."""
    pieces = table(spark, d, "pages").select(F.length("html").alias("size"), F.explode(F.split("url", "/")).alias("name"))
    names = namespace.intern(pieces, "name").withColumnRenamed("hash", "id")
    tree = pieces.filter("size > 2000").select(F.md5(F.col("name").cast("binary")).alias("name_id"))
    return gc.dead_names(names, tree).withColumnRenamed("id", "hash")


@query(f"{DEAD} SELECT id FROM inodes WHERE id NOT IN (SELECT inode_id FROM idx)")
def gc_inodes(spark, d):
    return gc.dead_inodes(inodes(spark, d), index(spark, d)).select("id")


@query(f"{DEAD} SELECT inode_id, block_number FROM idx WHERE inode_id NOT IN (SELECT id FROM inodes WHERE nlinks > 0)")
def gc_indexes(spark, d):
    return gc.dead_of_inodes(index(spark, d), inodes(spark, d).filter("nlinks > 0")).select("inode_id", "block_number")


@query(f"{DEAD}, {SIZES} SELECT hash_id, writed_size, compressed_size FROM sizes WHERE hash_id NOT IN (SELECT hash_id FROM live)")
def gc_blocks(spark, d):
    return gc.dead_hashes(sizes(spark, d), live_index(spark, d))


@query(f"{DEAD}, o AS (SELECT DISTINCT hash_id, l_suppkey FROM log) SELECT hash_id, l_suppkey FROM o WHERE hash_id NOT IN (SELECT hash_id FROM live)")
def gc_owners(spark, d):
    owners = write_log(spark, d).select("hash_id", "l_suppkey").distinct()
    return gc.dead_owners(owners, live_index(spark, d))


@query("o AS (SELECT DISTINCT l_partkey AS hash_id, l_suppkey AS owner FROM lineitem) SELECT hash_id, count(*) AS owners FROM o GROUP BY 1")
def owner_pairs(spark, d):
    return write_log(spark, d).select("hash_id", "l_suppkey").distinct().groupBy("hash_id").agg(F.count(F.lit(1)).alias("owners"))


@query(f"""{DEAD}, {SIZES} SELECT 'inode' AS name, count(*) AS total, count(*) FILTER (WHERE nlinks = 0) AS dead FROM inodes
UNION ALL SELECT 'inode_hash_block', count(*), count(*) - (SELECT count(*) FROM live) FROM idx
UNION ALL SELECT 'hash_sizes', count(*), count(*) FILTER (WHERE hash_id NOT IN (SELECT hash_id FROM live)) FROM sizes""")
def gc_summary(spark, d):
    i, x, s = inodes(spark, d), index(spark, d), sizes(spark, d)
    live = live_index(spark, d)
    return gc.summary({"inode": (i, i.filter("nlinks = 0")), "inode_hash_block": (x, gc.dead_of_inodes(x, i.filter(LIVE))), "hash_sizes": (s, gc.dead_hashes(s, live))})


def stored_documents(spark, d):
    own = document_blocks(spark, d)
    return own.select("digest", F.col("stored").alias("data")).dropDuplicates(["digest"])


@query(f"{CHUNKS} SELECT count(DISTINCT digest) AS total, count(DISTINCT digest) FILTER (WHERE digest[1] <> '0') AS valid FROM blocks")
def verify_blocks(spark, d):
    """Blocks whose digest starts with 0 are damaged first; verification must find them."""
    bad = F.when(F.col("digest").startswith("0"), F.concat("data", F.lit("!").cast("binary"))).otherwise(F.col("data"))
    return integrity.verified_counts(integrity.verify(stored_documents(spark, d).withColumn("data", bad), codec=None))


@query(f"{CHUNKS} SELECT DISTINCT digest AS old_digest, sha256(unhex(x)) AS digest FROM chunks JOIN blocks USING (doc_id, block_number)")
def rehash_blocks(spark, d):
    return integrity.rehash(stored_documents(spark, d).withColumn("old_digest", F.col("digest")), "sha256", codec=None).select("old_digest", "digest")


@query()
def recompress_best_of_n(spark, d):
    """Document blocks in the best of four codecs: how many blocks each wins, and their bytes."""
    raw = stored_documents(spark, d).withColumn("codec", F.lit("none"))
    out = integrity.recompress(raw, EngineConfig(codecs=("zlib", "zstd", "lz4", "brotli:4"), minimal_size=64))
    return out.groupBy("codec").agg(F.count(F.lit(1)).alias("cnt"), F.sum("writed_size").alias("writed_size"), F.sum("compressed_size").alias("compressed_size"))


@query(f"{CHUNKS} SELECT count(DISTINCT digest) AS total, count(DISTINCT digest) AS same FROM blocks")
def codec_round_trip(spark, d):
    made = stored_documents(spark, d).withColumn("p", codecs.packed(F.col("data"), EngineConfig(codecs=("all_fast",), minimal_size=16)))
    back = codecs.unpacked(F.col("p.codec"), F.col("p.data"))
    return made.select("data", back.alias("back")).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("data") == F.col("back"), 1)).alias("same"))


# ---- names


@query("n AS (SELECT DISTINCT unnest(string_split(url, '/')) AS value FROM pages) SELECT md5(value) AS hash, value FROM n")
def names_intern(spark, d):
    return namespace.intern(table(spark, d, "pages").select(F.explode(F.split("url", "/")).alias("name")), "name")


def tree_and_names(spark, d):
    """regions over nations over customers."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    rows = (
        r.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
        .unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name")))
        .unionByName(c.select((F.col("c_custkey") + 1000).alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("name")))
    )
    tree = rows.select("id", "parent_id", F.col("id").alias("name_id"), F.col("id").alias("inode_id"))
    return tree, rows.select("id", F.col("name").alias("value"))


TREE = """RECURSIVE nodes AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name FROM customer)"""


@query(f"{TREE}, walk AS (SELECT id, name AS path, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name, depth + 1 FROM walk w JOIN nodes n ON n.parent_id = w.id) SELECT id, path, depth FROM walk")
def tree_paths(spark, d):
    return namespace.paths(*tree_and_names(spark, d))


@query("c AS (SELECT c_custkey + 1000 AS id, c_name AS name, CAST(33188 AS BIGINT) AS mode, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer WHERE c_nationkey = 5 AND c_custkey > 200 ORDER BY c_custkey LIMIT 20) SELECT id, name, id AS inode_id, mode, size FROM c")
def readdir_page(spark, d):
    tree, names = tree_and_names(spark, d)
    own = table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id"), F.lit(0o100644).cast("long").alias("mode"), long("c_acctbal").alias("size"))
    return namespace.readdir(tree, names, own, 105, after=1200, limit=20)


@query("w AS (SELECT n_nationkey + 100 AS parent_id, '..' AS name, n_regionkey + 1 AS id FROM nation UNION ALL SELECT n_nationkey + 100, '.', n_nationkey + 100 FROM nation UNION ALL SELECT n_regionkey + 1, n_name, n_nationkey + 100 FROM nation) SELECT CAST(parent_id AS BIGINT) AS parent_id, name, CAST(id AS BIGINT) AS id, CAST(id * 1000 AS BIGINT) AS size, CAST(floor(id * 1000 / 512) AS BIGINT) AS st_blocks FROM w")
def tree_lookup(spark, d):
    tree, names = tree_and_names(spark, d)
    n = table(spark, d, "nation")
    at = (F.col("n_nationkey") + 100).cast("long").alias("parent_id")
    wanted = n.select(at, F.lit("..").alias("name")).unionByName(n.select(at, F.lit(".").alias("name"))).unionByName(n.select((F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name")))
    zero = [F.lit(0).cast("long").alias(c) for c in ("nlinks", "mode", "uid", "gid", "rdev", "atime_ns", "mtime_ns", "ctime_ns")]
    own = tree.filter("id < 1000").select("id", (F.col("id") * 1000).alias("size"), *zero)
    return namespace.lookup(tree.filter("id < 1000"), names, own, wanted).select("parent_id", "name", "id", "size", "st_blocks")


@query("""i AS (SELECT o_orderkey, o_orderkey % 512 AS mode, o_custkey % 3 AS o, o_orderkey % 4 AS g, o_orderkey % 5 AS uid, o_custkey % 4 AS gid FROM orders)
SELECT o_orderkey, (uid = 0 OR gid = 0 OR ((CASE WHEN uid = o THEN mode >> 6 WHEN gid = g THEN mode >> 3 ELSE mode END) & 4) = 4) AS r, (uid = 0 OR gid = 0 OR ((CASE WHEN uid = o THEN mode >> 6 WHEN gid = g THEN mode >> 3 ELSE mode END) & 3) = 3) AS wx FROM i""")
def access_check(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bits = lambda wanted: access.allowed(k % 512, c % 3, k % 4, k % 5, c % 4, wanted)
    return table(spark, d, "orders").select("o_orderkey", bits(access.READ).alias("r"), bits(access.WRITE | access.EXECUTE).alias("wx"))


def xattrs(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("inode_id"), F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("user.kind"), F.col("event_type"))).alias("attrs"))


@query("x AS (SELECT event_id AS inode_id, json_keys(props) AS k FROM events) SELECT inode_id, list_sort(list_append(k, 'user.kind')) AS names FROM x")
def xattr_list(spark, d):
    return namespace.xattr_list(xattrs(spark, d))


@query("x AS (SELECT event_id AS inode_id, json_extract_string(props, '$.k') AS value FROM events) SELECT inode_id, value FROM x WHERE value IS NOT NULL")
def xattr_get(spark, d):
    return namespace.xattr_get(xattrs(spark, d), "k")


# ---- snapshots


def dated(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey")).alias("name"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderstatus") == "F").alias("readonly"))


@query("x AS (SELECT 's' || o_orderkey AS name, o_orderdate AS created_at FROM orders) SELECT name FROM x WHERE created_at < TIMESTAMP '1996-03-01 00:00:00'")
def snapshots_older_than(spark, d):
    return snapshots.older_than(dated(spark, d), "1996-03-01T00:00:00").select("name")


@query("x AS (SELECT o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-08-02') SELECT (SELECT count(*) FROM x) AS all_cnt, (SELECT count(*) FROM x WHERE o_orderstatus = 'F') AS readonly_cnt")
def snapshots_created_today(spark, d):
    rows = dated(spark, d)
    every = snapshots.created_on(rows, "1998-08-02").select(F.col("cnt").alias("all_cnt"))
    return every.crossJoin(F.broadcast(snapshots.created_on(rows, "1998-08-02", True).select(F.col("cnt").alias("readonly_cnt"))))  # one row each


RETAIN = f"""t AS (SELECT DISTINCT o_orderdate AS made_at FROM orders WHERE o_orderdate <= TIMESTAMP '{NOW}'),
b AS (SELECT made_at, 'day' AS kind, date_diff('day', made_at, TIMESTAMP '{NOW}') AS bin, {PLAN.daily} AS m FROM t UNION ALL SELECT made_at, 'week', date_diff('day', made_at, TIMESTAMP '{NOW}') // 7, {PLAN.weekly} FROM t
UNION ALL SELECT made_at, 'month', date_diff('month', made_at, TIMESTAMP '{NOW}'), {PLAN.monthly} FROM t UNION ALL SELECT made_at, 'year', date_diff('year', made_at, TIMESTAMP '{NOW}'), {PLAN.yearly} FROM t),
keep AS (SELECT DISTINCT CASE WHEN kind = 'day' THEN max(made_at) ELSE min(made_at) END AS made_at FROM b WHERE bin >= 0 AND bin < m GROUP BY kind, bin)"""


def dates(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderdate").alias("made_at"))


@query(f"{RETAIN} SELECT made_at FROM keep")
def retention_keep(spark, d):
    return snapshots.retained(dates(spark, d), "made_at", NOW, PLAN)


@query(f"{RETAIN} SELECT DISTINCT o_orderdate AS made_at FROM orders WHERE o_orderdate NOT IN (SELECT made_at FROM keep)")
def retention_remove(spark, d):
    return snapshots.removed(dates(spark, d), "made_at", NOW, PLAN)


@query(f"{RETAIN} SELECT (SELECT count(DISTINCT o_orderdate) FROM orders) - (SELECT count(*) FROM keep) AS removed, (SELECT count(*) FROM keep) AS kept")
def retention_count(spark, d):
    gone = snapshots.removed(dates(spark, d), "made_at", NOW, PLAN).agg(F.count(F.lit(1)).alias("removed"))
    return gone.crossJoin(F.broadcast(snapshots.retained(dates(spark, d), "made_at", NOW, PLAN).agg(F.count(F.lit(1)).alias("kept"))))  # one row each


@query(f"{NATION_INDEX} SELECT subvol, count(*) AS cnt, CAST(sum(real_size) AS BIGINT) AS real_size FROM (SELECT * FROM nidx UNION ALL SELECT 99, inode_id, block_number, hash_id, real_size FROM nidx WHERE subvol = 3) GROUP BY 1")
def snapshot_create_union(spark, d):
    own = nation_index(spark, d)
    both = own.unionByName(snapshots.copy(own, 3, 99, by="subvol"))
    return both.groupBy("subvol").agg(F.count(F.lit(1)).alias("cnt"), usage.total("real_size", "real_size"))


@query(f"{NATION_INDEX} SELECT DISTINCT hash_id FROM nidx WHERE subvol = 1 INTERSECT SELECT DISTINCT hash_id FROM nidx WHERE subvol = 2")
def shared_hashes(spark, d):
    own = nation_index(spark, d)
    return own.filter("subvol = 1").select("hash_id").intersect(own.filter("subvol = 2").select("hash_id"))


# ---- labels


@query("""s AS (SELECT o_orderkey, CAST(floor(o_totalprice * (CASE o_orderkey % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 1 WHEN 2 THEN 1024 ELSE 2000000 END)) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN CASE WHEN n % 1099511627776 = 0 THEN (n // 1099511627776) || ' TiB' ELSE printf('%.2f TiB', n / 1099511627776.0) END WHEN n >= 1073741824 THEN CASE WHEN n % 1073741824 = 0 THEN (n // 1073741824) || ' GiB' ELSE printf('%.2f GiB', n / 1073741824.0) END
WHEN n >= 1048576 THEN CASE WHEN n % 1048576 = 0 THEN (n // 1048576) || ' MiB' ELSE printf('%.2f MiB', n / 1048576.0) END WHEN n >= 1024 THEN CASE WHEN n % 1024 = 0 THEN (n // 1024) || ' KiB' ELSE printf('%.2f KiB', n / 1024.0) END ELSE n || ' bytes' END AS label FROM s""")
def format_size_labels(spark, d):
    k = F.col("o_orderkey") % 4
    n = F.floor(F.col("o_totalprice") * F.when(k == 0, 0.01).when(k == 1, 1.0).when(k == 2, 1024.0).otherwise(2000000.0)).cast("long")
    return table(spark, d, "orders").select("o_orderkey", text.format_size(n).alias("label"))


_UNITS = (("year", 31536000, 10**9), ("week", 604800, 31536000), ("day", 86400, 604800), ("hour", 3600, 86400), ("minute", 60, 3600), ("second", 1, 60))
_SPAN = ", ".join(f"CASE WHEN (n % {over}) // {u} = 1 THEN '1 {name}' WHEN (n % {over}) // {u} > 1 THEN ((n % {over}) // {u}) || ' {name}s' END" for name, u, over in _UNITS)
# what is left of a year is divided by weeks, so each unit takes the rest of all before it
_SPAN = _SPAN.replace("(n % 86400)", "(n % 31536000 % 604800 % 86400)").replace("(n % 604800)", "(n % 31536000 % 604800)").replace("(n % 3600)", "(n % 31536000 % 604800 % 86400 % 3600)").replace("(n % 60)", "(n % 31536000 % 604800 % 86400 % 3600 % 60)")


@query(f"""s AS (SELECT p_partkey, CAST(p_partkey * p_partkey * 7 % 100000000 AS BIGINT) AS n FROM part), l AS (SELECT p_partkey, n, list_filter([{_SPAN}], lambda x: x IS NOT NULL) AS p FROM s)
SELECT p_partkey, CASE WHEN n < 1 THEN 'less than a second' WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] ELSE p[1] END AS label FROM l""")
def format_timespan_labels(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", text.format_timespan(k * k * 7 % 100000000).alias("label"))


# ---- caches and streams


@query("""e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, k""")
def write_cache_sessions(spark, d):
    return jobs.idle_sessions(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", idle="2 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "expires")})


@query("t AS (SELECT time_bucket(INTERVAL 5 SECOND, ts) AS tick FROM events) SELECT tick, count(*) AS n FROM t GROUP BY 1")
def flush_ticks(spark, d):
    return jobs.flush_ticks(table(spark, d, "events")).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("t AS (SELECT user_id, time_bucket(INTERVAL 1 SECOND, ts) AS w, max(ts) AS updated_at FROM events GROUP BY ALL) SELECT user_id, updated_at FROM t")
def subvolume_touch_debounce(spark, d):
    return jobs.debounced(table(spark, d, "events"), "user_id")


@query("""w AS (SELECT event_id, user_id, n, sum(n) OVER (PARTITION BY user_id) AS a, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS u FROM (SELECT *, CAST(floor(value) AS BIGINT) + 1 AS n FROM events))
SELECT event_id, user_id, n FROM w WHERE a > 1000 * 1.02 AND a - (u - n) > 1000 * 0.98""")
def evict_oldest_until_budget(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", (long("value") + 1).alias("n"))
    return jobs.evicted(rows, "n", [F.col("ts")], 1000, by="user_id").select("event_id", "user_id", "n")


def _stream(spark, d):
    return jobs.replay(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """A stream's result so far: written to the shared folder, batch by batch, and read again."""
    from cairn.sources.shared import scratch

    spark = stream.sparkSession
    folder = scratch(spark, "stream")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{folder}/out")


@query("x AS (SELECT md5(event_type || user_id) AS digest FROM events) SELECT DISTINCT digest FROM x")
def stream_dedup(spark, d):
    """New digests of a replayed stream, once each."""
    rows = _stream(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), F.md5(F.concat("event_type", F.col("user_id").cast("string")).cast("binary")).alias("digest"))
    return _drained(jobs.dedup_stream(rows, lateness="1 hour").select("digest"), "append")


@query("x AS (SELECT user_id, max([event_id]) AS m, max(ts) AS ts FROM events GROUP BY 1) SELECT x.user_id, x.ts, e.event_type FROM x JOIN events e ON e.user_id = x.user_id AND e.ts = x.ts")
def stream_last_wins(spark, d):
    return _drained(jobs.last_state(_stream(spark, d).select("user_id", "ts", "event_type"), "user_id", "ts"), "complete")


from cairn.plans import table_queries  # noqa: E402, F401  (adds its queries)
