import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import common
from cairn.llm import substring as ss
from cairn.llm.fmindex import FMIndex


def brute(docs, w=ss.WINDOW):
    words = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(docs, words, strict=True):
        drop = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                drop.update(range(i, i + w))
        out.append((d, len(x), len(drop), b" ".join(y for i, y in enumerate(x) if i not in drop).decode()))
    return sorted(map(str, out))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=120), st.integers(1, 9))
def test_matching_statistics(symbols, most):
    text = np.array([*[x + 1 for x in symbols], 0])
    index = FMIndex(text, 6, 16)
    got = index.matching_statistics(text, np.arange(len(symbols)), np.minimum(most, np.arange(len(symbols)) + 1))
    for e in range(len(symbols)):
        best = 0
        for n in range(1, min(most, e + 1) + 1):
            p = symbols[e - n + 1 : e + 1]
            if sum(symbols[i : i + n] == p for i in range(len(symbols) - n + 1)) >= 2:
                best = n
        assert got[e] == best


def test_words():
    texts = [b"", b" a  bc\t", b"d", b"ef gh", b"\n", b"\xc3\xa9\xa0 x"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends, first = ss.words_of(raw, at)
    got = [[bytes(raw[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [t.split() for t in texts]


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (34, 35, 36, 50, 90)]
    docs = []
    for d in range(150):
        x = say(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            x[(at := r.randint(0, len(x))) : at] = p[r.randint(0, 3) :]
        docs.append((d, r.choice([" ", "\n", " \t "]).join(x)))
    docs += [(200, None), (201, ""), (202, "a " * 300), (203, "a b " * 60), (206, "b a " * 70 + "c"), (207, "q r s " * 33), (204, " ".join(passages[4] * 2)), (None, docs[7][1]), (205, docs[7][1]), (9, docs[9][1]), (None, "x " * 40)]
    return docs


@pytest.mark.parametrize(("hot", "shard"), [(4096, 150_000), (2, 150_000), (12, 150_000), (4096, 2_000)])
def test_against_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(ss, "HOT", hot)
    monkeypatch.setattr(ss, "SHARD", shard)
    docs = corpus()
    frame = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, start int, segment string")
    got = sorted(str(tuple(r)) for r in ss.remove_repeats(frame).collect())
    assert got == brute(docs)


def test_segments_by_grams_of_any_length():
    """Equal windows have equal minimisers, and segments cover each window once, for every length of gram."""
    r = np.random.default_rng(5)
    words = r.integers(0, 3, 400).astype(np.uint64)
    words[200:300] = words[50:150]
    h, first = ss.mix(words + np.uint64(1)), np.array([0, 30, 180, 400])
    for gram in ss.GRAMS:
        start, count, low, _ = ss.segments(h, first, gram)
        of_window, seen = {}, []
        for s, n, key in zip(start.tolist(), count.tolist(), low.tolist(), strict=True):
            for w in range(s, s + n):
                seen.append(w)
                assert of_window.setdefault(tuple(words[w : w + ss.WINDOW].tolist()), key) == key
        assert seen == [w for a, b in zip(first[:-1], first[1:], strict=True) for w in range(a, b - ss.WINDOW + 1)]


def test_many_segments_of_one_minimiser(spark, monkeypatch):
    """A common phrase in ever other company: its shard is split, and split again."""
    monkeypatch.setattr(ss, "HOT", 8)
    r = random.Random(8)
    phrase, passage = [f"p{i}" for i in range(30)], [f"q{i}" for i in range(45)]
    docs = []
    for d in range(200):
        x = [f"w{r.randrange(10**6)}" for _ in range(40)]
        x[20:20] = phrase if d % 2 else passage[d % 9 :]
        docs.append((d, " ".join(x)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(tuple(x)) for x in ss.remove_repeats(frame).collect()) == brute(docs)


def test_marks_by_chance_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP", 128)
    docs = corpus(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(tuple(x)) for x in ss.remove_repeats(frame).collect()) == brute(docs)


def test_no_rows(spark):
    assert ss.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
