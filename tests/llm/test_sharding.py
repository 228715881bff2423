import random
import zlib

from cairn.llm import sharding as s


def corpus():
    r = random.Random(4)
    docs = [(i, "wé " * r.choice([1, 3, 10, 60, 900])) for i in range(800)]
    return [*docs, (900, None), (901, ""), (None, "x"), (None, "x"), *[(5, docs[5][1])] * 40, (5, "another"), (902, "y" * 200_000)]


def test_shards(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, size int, shard int")
    got = s.shard_documents(frame, 8).collect()
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    assert sorted(str((x.doc_id, x["size"], x.text_crc32)) for x in got) == want
    bytes_of = [0] * 8
    for x in got:
        bytes_of[x.shard] += x["size"]
    assert sum(bytes_of) == sum(x["size"] for x in got)
    slots = {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = sorted(bytes_of)[:-1]  # one shard holds the long text
    assert max(rest) - min(rest) < 0.05 * max(rest)
    assert s.shard_documents(frame.limit(0), 8).count() == 0


def test_bytes_are_even_where_ids_are_not(spark):
    """Null ids, one id with many texts, equal rows."""
    many = [(None, f"text {i}") for i in range(2000)]
    one = [(7, f"another {i} " * 3) for i in range(2000)]
    equal = [(9, "the same")] * 50_000
    for docs in (many, one, equal, many + one + equal[:3000]):
        got = s.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 8, 1024).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
        size = [r["sum(size)"] for r in got]
        assert len(got) == 8 and max(size) < 1.05 * min(size)
        assert all(r["max(slot)"] == r["count(1)"] - 1 for r in got)


def test_map_is_versioned_and_edited(spark, tmp_path):
    r = random.Random(1)
    sizes = {v: r.randint(1, 100) for v in range(0, 512)}
    one = s.first_map(sizes, 4, 512)
    load = lambda m, sz: [sum(n for v, n in sz.items() if m.shard_of[v] == k) for k in range(m.n_shards)]
    assert max(load(one, sizes)) - min(load(one, sizes)) <= 2
    grown = s.rebalance(one, sizes, 5)
    assert grown.version == 2 and {grown.shard_of[v] for v in range(512) if grown.shard_of[v] != one.shard_of[v]} == {4}
    assert max(load(grown, sizes)) - min(load(grown, sizes)) <= 100
    sizes[7] = 5000
    again = s.rebalance(grown, sizes)
    assert sum(a != b for a, b in zip(again.shard_of, grown.shard_of, strict=True)) < 300
    assert s.rebalance(again, sizes).shard_of == again.shard_of
    for m in (one, grown, again):
        m.save(spark, str(tmp_path / "map"))
    assert s.SlotMap.load(spark, str(tmp_path / "map")) == again and s.SlotMap.load(spark, str(tmp_path / "map"), 1) == one
    fewer = s.rebalance(again, sizes, 2)
    assert set(fewer.shard_of) == {0, 1}
