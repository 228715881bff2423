import itertools
import random
import re

import numpy as np
import xxhash

from cairn.llm import simhash as sh
from cairn.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = {f for _, f in rows}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(str((i, f"{f:016x}", least.get(find(f)))) for i, f in rows)


def test_triples_meet_every_four_positions():
    assert len(sh.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in sh.TRIPLES) for four in itertools.combinations(range(8), 4))


def test_tally_counts_shared_bytes():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**64, 4000, dtype=np.uint64)
    keep = r.integers(0, 256, 4000, dtype=np.uint64)
    mask = sum(((keep >> np.uint64(i)) & np.uint64(1)) * np.uint64(0xFF << (8 * i)) for i in range(8))
    apart = x & mask
    assert (sh.tally(apart) == (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)).all()


def test_a_very_long_text():
    t = "one two three four five six " * 30_000
    assert sh.fingerprint(t.encode()) == slow_fingerprint(t)


def test_fingerprints():
    for t in ("", " \n", "One", "a b c", "A b C d", "the cat sat on the mat " * 30, "Ünïcode wörter sind ok É"):
        assert sh.fingerprint(t.encode()) == slow_fingerprint(t)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(5000, x) for x in range(5001, 5200)] + [(-7, -7), (-9, 2**40)]
    got = {x.v: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {v: got.get(v, v) for v in root} == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(r, center, most):
    out = center
    for b in r.sample(range(64), r.randint(0, most)):
        out ^= 1 << b
    return out


def test_links_join_what_all_pairs_join(spark, monkeypatch):
    """Sparse and dense groups, also where postings are split into blocks."""
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1}
    for _ in range(4):
        center = r.getrandbits(64)
        fps |= {near(r, center, 3) for _ in range(120)} | {near(r, center, 9) for _ in range(60)}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    frame = spark.createDataFrame([(i, signed(f)) for i, f in rows], "doc_id long, fp long")
    for block, paired in ((2048, 256), (16, 256), (2048, 0)):
        monkeypatch.setattr(sh, "BLOCK", block)
        monkeypatch.setattr(sh, "PAIRED", paired)
        edges = sh.link_edges(frame.select("fp"))
        assert all((a ^ b & (2**64 - 1)) and ((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in edges.collect())
        root = {x.v: x.root for x in components(edges).collect()}
        label, least = {i: root.get(signed(f), signed(f)) for i, f in rows}, {}
        for i, x in label.items():
            least[x] = min(i, least.get(x, i))
        assert sorted(str((i, f"{f:016x}", least[label[i]])) for i, f in rows) == brute(rows)


def corpus():
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(150):
        if i % 3 and docs:
            t = r.choice(docs)[1].split(" ")
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = "Changed"
        else:
            t = [r.choice(words) for _ in range(r.randint(1, 300))]
        docs.append((i, " ".join(t)))
    return [*docs, (400, None), (401, ""), (402, " \t"), (403, "one"), (404, "ONE"), (None, docs[0][1]), (None, "nobody else"), (7, docs[7][1]), (8, "another text under an id that is taken")]


def test_documents(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*d, 3, "clash") for d in docs], "doc_id long, text string, fp int, posting string")
    got = sh.near_duplicates(frame)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(str(tuple(x)) for x in got.collect()) == brute([(i, slow_fingerprint(t)) for i, t in docs])
    assert sh.near_duplicates(frame.limit(0)).count() == 0
    kept = sh.keep_one(frame)
    assert kept.columns == frame.columns
    found = {i: c for i, c in ((x.doc_id, x.component_id) for x in got.collect())}
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids))
    assert {i for i in ids if i is not None} == {c for i, c in found.items() if i == c and i is not None} | ({8} if 8 in ids else set())
    assert np.all([i in ids for i in (400, 403)]) and 401 not in ids and 404 not in ids and ids.count(None) == 1


def test_one_row_of_each_component(spark):
    """Null ids, an id that several texts share, equal rows: a component keeps one row, and is lost only to another of the same id."""
    r = random.Random(17)
    say = lambda: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 9) for _ in range(60))
    texts = [say() for _ in range(30)]
    docs = [(None, t, "a") for t in texts[:20]] + [(5, t, None) for t in texts[20:24]] + [(i, t, "a") for i, t in enumerate(texts[24:], 100)]
    docs += [(None, texts[0], "b"), (3, texts[1], "a"), (50, texts[20], "a"), (4, texts[21], "a"), (100, texts[24], "a"), (None, texts[2], "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = [tuple(x) for x in sh.keep_one(frame).collect()]
    assert len({slow_fingerprint(t) for t in texts}) == len(texts) and all(x in docs for x in kept)
    least = {t: min((i for i, x, _ in docs if x == t and i is not None), default=None) for t in texts}
    fives = {t for t in texts if least[t] == 5}
    assert len(fives) == 3 and sum(t in fives for _, t, _ in kept) == 1
    assert sorted(t for _, t, _ in kept if t not in fives) == sorted(set(texts) - fives)
    assert all(i == least[t] for i, t, _ in kept)
