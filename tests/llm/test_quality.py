import zlib

import numpy as np

from cairn.llm import quality as q


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        seen = np.zeros(n, bool)
        for s in q.chunk_starts(n):
            seen[s : s + q.CHUNK] = True
        assert seen.all()


def test_gradients():
    net = q.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, first = q.cut(*packed(["the quick brown fox " * 40, "AB!! CD!! " * 9]))
    y = np.array([1.0, 0.0])

    def loss():
        z = net._texts(net._filters(x), first) @ net.p["w3"] + net.p["b3"]
        return -np.mean(y * np.log(1 / (1 + np.exp(-z))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-z))))

    g = net._gradients(x, first, y)
    r = np.random.default_rng(0)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for at in r.choice(flat.size, min(6, flat.size), replace=False) if k != "code" else [116 * q.CODE + 1, 33 * q.CODE]:
            was = flat[at]
            flat[at] = was + 1e-6
            up = loss()
            flat[at] = was - 1e-6
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[at]) < 1e-4, k


def corpus(spark):
    r = np.random.default_rng(5)
    words = ["and", "the", "river", "stone", "green", "walks", "under", "light"]
    rows = []
    for i in range(400):
        w = r.choice(words, int(r.integers(5, 200)))
        rows.append((i, " ".join(w) if i % 3 else "!! ".join(x.upper() for x in w) + "!!", 0 if i % 3 == 0 else 1))
    docs = spark.createDataFrame([(i, t, 0.5, i) for i, t, _ in rows] + [(900, "", 0.1, 1), (901, None, 0.1, 1), (None, "the river", 0.1, 1), (5, rows[5][1], 0.5, 5)], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, rows = corpus(spark)
    got = q.classify(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for i, _, _ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by[i].predicted == int(by[i].score >= 0.7)
    out = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert np.mean([a == b for a, b in out]) > 0.95
    assert by[900].score == by[901].score and 0 <= by[900].score <= 1
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def trained(seed=2):
    r = np.random.default_rng(seed)
    net = q.Network(seed)
    say = lambda letters, n: "".join(r.choice(list(letters), n)).encode()
    texts = [(q.cut(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0], y) for y in (0, 1) for t in [say("ab c!" if y else "xyz Q", int(r.integers(1, 1500))) for _ in range(12)]]
    net.train(texts, steps=40, size=8)
    net.q = net.round(np.concatenate([x for x, _ in texts]))
    return net


def slow_score(net, text):
    """One place, one filter at a time, in Python's whole numbers."""
    w, raw, found = net.q, text.encode(), []
    whole = lambda x: [[int(v) for v in row] for row in x]
    code, w1, b1, w2, b2 = whole(w["code"]), whole(w["w1"].T), [int(v) for v in w["b1"]], whole(w["w2"].T), [int(v) for v in w["b2"]]
    for s in q.chunk_starts(len(raw)).tolist():
        x = raw[s : s + q.CHUNK].ljust(q.CHUNK, b"\0") if s + q.CHUNK <= len(raw) else raw[s:].ljust(q.CHUNK, b"\0")
        again = [int(x[i] != 0 and i + 4 <= len(x) and any(i >= lag and x[i : i + 4] == x[i - lag : i - lag + 4] for lag in range(2, 25)) and i < len(x) - 3) for i in range(len(x))]
        seen = [[*code[b], int(w["one"]) * a] for b, a in zip(x, again)]
        h1 = []
        for at in range(0, q.PLACES * q.STRIDE, q.STRIDE):
            row = [v for place in seen[at : at + q.WIDTH] for v in place]
            h1.append([max(0, sum(a * b for a, b in zip(row, f)) + c) for f, c in zip(w1, b1)])
        h2 = []
        for k in range(q.POOLED):
            m = [int(min(np.float32(sum(h1[k * q.POOL_STEP + j][f] for j in range(q.POOL))) * w["by_m"], np.float32(q.LEVELS2))) for f in range(q.FILTERS)]
            h2.append([max(0, sum(a * b for a, b in zip(m, f)) + c) for f, c in zip(w2, b2)])
        found.append([max(x) for x in zip(*h2)])
    z = float(w["b3"][0])
    for j, column in enumerate(zip(*found)):
        z += sum(column) / len(found) * (float(w["w3"][j]) / float(w["unit"]))
        z += max(column) * (float(w["w3"][q.SECOND + j]) / float(w["unit"]))
    return 1 / (1 + np.exp(-z))


def test_against_a_slow_scorer():
    net = trained()
    texts = ["", "a", "ab c! " * 50, "xyz QQ " * 200, "é" * 600]
    got = net.scores(*packed(texts))
    assert all(abs(a - slow_score(net, t)) < 1e-12 for a, t in zip(got, texts))


def test_a_text_scores_the_same_in_any_company():
    net = trained()
    r = np.random.default_rng(1)
    others = ["".join(r.choice(list("abxyz !Q"), int(r.integers(0, 900)))) for _ in range(300)]
    for text in ("", "ab c! " * 30, "x" * 5000):
        alone = net.scores(*packed([text]))[0]
        for n in (1, 7, 300):
            assert net.scores(*packed([text, *others[:n]]))[0] == net.scores(*packed([*others[:n], text]))[-1] == alone
    together = net.scores(*packed(others * 14))  # 4200 rows
    assert (together == np.concatenate([net.scores(*packed([t])) for t in others] * 14)).all()


def test_gradients_of_many_chunks_are_the_sum_of_portions(monkeypatch):
    net = q.Network(3)
    x, first = q.cut(*packed(["the quick brown fox " * 200, "AB!! CD!! " * 90, "x"]))
    y = np.array([1.0, 0.0, 1.0])
    whole = net._gradients(x, first, y)
    monkeypatch.setattr(q, "PART", 2)
    for k, d in net._gradients(x, first, y).items():
        assert np.allclose(d, whole[k], atol=1e-5), k


def test_repeated_ids_and_very_long_texts_in_training(spark, monkeypatch):
    monkeypatch.setattr(q, "LONGEST", 2000)
    docs, labels, _ = corpus(spark)
    more = spark.createDataFrame([(5, "!! " * 20_000, 0.5, 5)] * 50, "doc_id long, text string, score double, y int")
    a, b = q.train(docs, labels), q.train(docs.union(more), labels)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_no_labels_and_no_rows(spark):
    docs, labels, _ = corpus(spark)
    assert {r.score for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in q.classify(docs, labels.filter("quality = 1")).collect()} == {1}
    assert q.classify(docs.limit(0), labels).count() == 0
