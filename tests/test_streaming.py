import datetime as dt
import hashlib

from pyspark.sql import functions as F

from cairn.streaming import jobs


def test_ingest_stores_each_block_once(spark, tmp_path):
    source = tmp_path / "in"
    data = [[(1, b"AAAABBBB"), (2, b"AAAA")], [(3, b"BBBBCC\0\0")], [(4, b"DDDDDDDD")]]
    schema = "inode_id long, data binary"
    for i, rows in enumerate(data):
        spark.createDataFrame([(k, bytearray(v)) for k, v in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        if i == 1:
            jobs.ingest(jobs.replay(spark, str(source), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "cp"), 4, ["inode_id"]).awaitTermination()
    jobs.ingest(jobs.replay(spark, str(source), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "cp"), 4, ["inode_id"]).awaitTermination()
    stored = [bytes(r.stored) for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).collect()]
    assert sorted(stored) == [b"AAAA", b"BBBB", b"CC", b"DDDD"]
    index = spark.read.parquet(str(tmp_path / "out" / "index"))
    assert index.count() == 7 and {r.digest for r in index.collect()} == {hashlib.md5(x).hexdigest() for x in stored}


def test_batch_and_stream_agree(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 5, start + dt.timedelta(seconds=i * i % 97), f"v{i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "k long, ts timestamp, v string").withColumn("digest", F.md5(F.col("k").cast("string").cast("binary")))
    for part in frame.randomSplit([1.0, 1.0, 1.0], 1):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.replay(spark, str(tmp_path / "in"), frame.schema)
    last = jobs.last_state(stream.select("k", "ts", "v"), "k", "ts").writeStream.outputMode("complete").format("memory").queryName("last").trigger(availableNow=True).start()
    last.awaitTermination()
    assert {tuple(r) for r in spark.table("last").collect()} == {tuple(r) for r in jobs.last_state(frame.select("k", "ts", "v"), "k", "ts").collect()}
    once = jobs.dedup_stream(stream, lateness="1 hour").select("digest").writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 5


def test_eviction_stops_at_the_low_mark(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(20)], "age long, size long")
    gone = jobs.evicted(rows, "size", [F.col("age")], 100)
    assert sorted(r.age for r in gone.collect()) == list(range(11))
    assert jobs.evicted(rows, "size", [F.col("age")], 200).count() == 0
