import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import winnow


def brute(points, k, w):
    """Window by window: the least hash, of equal ones the rightmost."""
    if not len(points):
        return []
    k = min(k, len(points))
    base = int(winnow.BASE)
    hashes = []
    for i in range(len(points) - k + 1):
        h = 0
        for j in range(k):
            h = (h + (int(points[i + j]) + 1) * pow(base, j, 2**64)) % 2**64
        hashes.append(int(winnow.mix(np.array([h], np.uint64))[0] >> np.uint64(32)))
    w = min(w, len(hashes))
    chosen = set()
    for i in range(len(hashes) - w + 1):
        low = min(hashes[i : i + w])
        chosen.add(max(j for j in range(i, i + w) if hashes[j] == low))
    return [(j, hashes[j]) for j in sorted(chosen)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abé\U0001f600", max_size=120), st.integers(1, 20), st.integers(1, 40))
def test_against_windows_one_by_one(text, k, w):
    p = winnow.points_of(text)
    with np.errstate(over="ignore"):
        at, h = winnow.select(p, k, w)
    assert list(zip(at.tolist(), h.tolist(), strict=True)) == brute(p, k, w)
    if w < 256:
        at2, h2 = winnow.read(winnow.write(at, h))
        assert at2.tolist() == at.tolist() and h2.tolist() == h.tolist()


def test_shared_passage_is_found():
    rng = np.random.default_rng(1)
    passage = "".join(rng.choice(list("abcdefgh "), winnow.W + winnow.K - 1))
    a, b = ("".join(rng.choice(list("ijklmno "), 300)) for _ in range(2))
    (_, ha), (_, hb) = winnow.fingerprint(a + passage + b), winnow.fingerprint(b[:77] + passage + a[:50])
    assert len(np.intersect1d(ha, hb))


def test_query_rows(spark):
    texts = {5: "x" * 100, 1: None, 2: "", 9: "é" * 7 + "long text " * 30, 7: "b", 40: "c d", 12: "ab" * 40}
    rows = sorted(texts.items())
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], "doc_id long, text string, key string, run int")
    got = {r.doc_id: r for r in winnow.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(rows):
        t, following = t or "", rows[(n + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[i].fingerprint == winnow.fingerprint(t)[0] and got[i].edited_fingerprint == winnow.fingerprint(e)[0]
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1].near_next == 1 and got[7].near_next == 0
    assert winnow.fingerprints(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z"), (None, "q"), (None, None)], "doc_id long, text string")
    got = winnow.fingerprints(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "None", "None"]
    assert winnow.fingerprints(docs.filter("text = 'z'")).first().near_next == 1


def test_runs(spark):
    bounds = sorted({(i * i * 7919) % 100_003 - 50_000 for i in range(1000)})
    keys = [*bounds, *(b + 1 for b in bounds), -(2**63), 2**63 - 1, 0]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    for few in (bounds, bounds[:1], bounds[:2], bounds[:7]):
        got = frame.select("key", winnow._run_of(winnow.F.col("key"), few).alias("run")).collect()
        assert all(r.run == sum(b < r.key for b in few) for r in got)


def test_a_very_long_text_and_many_runs(spark):
    rows = [(i * 3, f"text number {i} " * (1 + i % 5)) for i in range(2000)] + [(10**6, "a long one, all of it " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in winnow.fingerprints(docs).collect()}
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        assert got[i].edited_sha256 == hashlib.sha256(winnow.edited(t, following).encode()).hexdigest()
