import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import attention as at
from cairn.llm import lm
from cairn.llm.queries import WORD_BPE

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="the vocabulary file is not here")


def small_model(v=12, seed=2):
    r = np.random.default_rng(seed)
    pairs = r.integers(0, 6, (v, v)).astype(float)
    return at.Attention(pairs)


def test_distributions_sum_to_one_and_see_nothing_later():
    m = small_model()
    r = np.random.default_rng(0)
    text = r.integers(0, 11, 70)
    first = np.array([0, 70])
    for place in (0, 1, 23, 24, 50, 69):
        total = 0.0
        for y in range(m.v):
            changed = text.copy()
            changed[place] = y
            changed[place + 1 :] = (changed[place + 1 :] + 5) % 11  # what follows must not matter
            total += 10 ** m.log_probs(changed, first, 11)[place]
        assert abs(total - 1) < 1e-4
    together = m.log_probs(np.concatenate([text, text[:30]]), np.array([0, 70, 100]), 11)
    assert np.allclose(together[:70], m.log_probs(text, first, 11), atol=1e-5)
    assert np.allclose(together[70:], m.log_probs(text[:30], np.array([0, 30]), 11), atol=1e-5)


def test_windows_score_each_place_once():
    first = np.array([0, 1, 24, 49, 149])
    places, start = at.windows(first)
    seen = Counter()
    for a, b in zip(places, start, strict=True):
        stop = min(a + at.S, first[np.searchsorted(first, b, "right")])
        seen.update(range(a, stop))
    assert sorted(seen) == list(range(149)) and set(seen.values()) == {1}


def test_gradients():
    m = small_model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(1)
    seen = r.integers(0, 12, (3, at.T))
    seen[0, :10] = m.v
    target = r.integers(0, m.p["w"].shape[1], (3, at.S))
    target[2, 5:] = -1

    def loss():
        z = m._forward(seen)
        good = target >= 0
        return -z[good, target[good]].mean()

    g = m._gradients(seen, target)
    for k, w in m.p.items():
        flat = w.reshape(-1)
        for i in r.choice(flat.size, min(8, flat.size), replace=False):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-4, k


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus():
    r = np.random.default_rng(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "on", "ir")] + ["é", "ST"]
    rows = []
    for i in range(300):
        words = ["".join(r.choice(syllables, int(r.integers(1, 5)))) for _ in range(int(r.integers(0, 80)))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (-1, None), (-2, ""), (None, rows[1][1]), (-3, "你好 \U0001f600 <|endoftext|>"), (-4, "a" * 3000), (5, rows[5][1])]


@pytest.mark.parametrize("top", [1 << 17, 5])
def test_against_counts(spark, monkeypatch, top):
    monkeypatch.setattr(lm, "TOP_WORDS", top)
    docs = corpus()
    frame = spark.createDataFrame([(*x, 1.0, 3) for x in docs], "doc_id long, text string, score double, n long")
    got = lm.score_documents(frame, WORD_BPE).collect()
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode()), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    count = Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    n, v = sum(count.values()), len(count)
    want = []
    for (i, _), x, h in zip(docs, words, held, strict=True):
        want.append((str(i), h, len(x), sum(count[w] > 0 for w in x), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), 5)))
    assert sorted((str(r.doc_id), *tuple(r)[1:5], round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_every_training_id_reaches_the_weights(spark):
    """A long text (over 1024 ids), several rounds and tasks: no token is left as it was drawn, and each is trained on once."""
    r = np.random.default_rng(4)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "bdgklmnrst"]
    docs = [(i, " ".join("".join(r.choice(syllables, 2)) for _ in range(6000 if i == 0 else 40))) for i in range(30)]
    prepared = lm.prepare(lm.keyed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), WORD_BPE).cache()
    model, spelling = lm.fit(prepared, WORD_BPE)
    texts = [np.frombuffer(x.ids, np.uint16) for x in prepared.filter("kind = 0 and not held_out").collect()]
    assert max(map(len, texts)) > 4 * 1024
    tokens = np.concatenate([spelling.tokens(x) for x in texts])
    drawn = at.Attention(np.zeros((model.v, model.v)))
    for k in "qkvr":
        assert (model.p[k] != drawn.p[k]).any(axis=1)[np.unique(tokens)].all(), k
    assert sum(lm.train_round(prepared, model, spelling, i) for i in range(lm.ROUNDS)) == len(tokens) + len(texts)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="the test tables are not here")
def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 6000")
    got = lm.score_documents(docs, WORD_BPE).filter("held_out").collect()
    assert len(got) > 700 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_no_rows_and_no_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none, WORD_BPE).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = lm.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string"), WORD_BPE).first()
    assert only.held_out and only.train_tokens == 0 and only.n_known == 0 and only.base_score == 0


def test_a_token_costs_one_groups_classes(monkeypatch):
    """Scoring takes exps of the groups and of one group's classes, not of every class."""
    r = np.random.default_rng(3)
    m = at.Attention(r.integers(0, 6, (400, 400)).astype(float))
    taken, exp = [], np.exp
    monkeypatch.setattr(at.np, "exp", lambda x, *a, **k: taken.append(np.size(x)) or exp(x, *a, **k))
    n = 24 * at.S
    m.log_probs(r.integers(0, 399, n), np.array([0, n]), 399)
    classes = m.p["w"].shape[1]
    assert classes > 64 and sum(taken) / n <= at.T + classes / 4
    assert max(np.bincount(m.group)) - min(np.bincount(m.group)) <= 1 and len(np.bincount(m.group)) == at.GROUPS


def test_runs_summed_in_twos_equal_single_sums():
    m = small_model()
    r = np.random.default_rng(6)
    seen, target = r.integers(0, 12, (20, at.T)), r.integers(0, m.p["w"].shape[1], (20, at.S))
    together = m._gradients(seen, target)
    apart = [m._gradients(seen[i : i + 1], target[i : i + 1]) for i in range(20)]
    for k, g in together.items():
        assert np.allclose(g, sum(x[k] for x in apart) / 20, atol=1e-6), k
