import random

import numpy as np

from cairn.llm import lines as ln


def parts(text):
    return [x.strip(" \t\n\v\f\r") for x in (text or "").split("\n")]


def shingle_set(line):
    k = ln.SHINGLE
    return {line[i : i + k] for i in range(max(1, len(line) - k + 1))}


def brute(docs):
    """All pairs of distinct lines, links at the threshold, components, first place of each."""
    low = lambda i: -(2**63) if i is None else i
    distinct = sorted({x for _, t in docs for x in parts(t) if x})
    sets, root = [shingle_set(x) for x in distinct], list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= ln.SIMILARITY * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    label = {x: find(i) for i, x in enumerate(distinct)}
    first = {}
    for i, t in docs:
        for n, x in enumerate(parts(t)):
            if x:
                first[label[x]] = min((low(i), n), first.get(label[x], (2**63, 0)))
    out = []
    for i, t in docs:
        for n, x in enumerate(parts(t)):
            keep = first[label[x]] if x else (low(i), n)
            out.append((i, n, None if keep[0] == -(2**63) else keep[0], keep[1], keep == (low(i), n)))
    return out


def corpus():
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefghijkléñß") for _ in range(r.randint(2, 9))) for _ in range(n))
    base = [say(r.randint(1, 40)) for _ in range(60)]
    rows = []
    for d in range(120):
        out = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(base) if r.random() < 0.5 else say(r.randint(1, 20))
            if r.random() < 0.5 and len(x) > 60:
                at = r.randrange(len(x))
                x = x[:at] + r.choice("xyz") + x[at + r.randint(0, 1) :]
            out.append(r.choice(["", " ", "\t"]) + x + r.choice(["", "\r", "  "]))
        rows.append((d, "\n".join(out)))
    return [*rows, (300, None), (301, ""), (302, "\n \n"), (303, base[0] + "\n" + base[0]), (None, base[1]), (304, "ab\nab\nb"), (305, "line " * 3000)]


def test_lines_of():
    texts = ["", "\n", "a\n", "\na\n\n b \r\nc", "é"]
    raw = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(x) for x in raw])]
    body = b"".join(raw)
    text, number, start, end = ln.lines_of(np.frombuffer(body, np.uint8), at)
    got = [[] for _ in texts]
    for t, n, a, b in zip(text, number, start, end, strict=True):
        assert n == len(got[t])
        got[t].append(body[a:b].decode())
    assert got == [parts(t) for t in texts]


def test_band_recall():
    r = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        x = r.integers(97, 123, 140, dtype=np.uint8)
        y = x.copy()
        y[int(r.integers(40, 100))] = 65  # 8 shingles of 133 differ: similarity 0.887
        k = [ln.band_keys(*ln.shingles(z, np.array([0]), np.array([len(z)])))[0] for z in (x, y)]
        found += bool((k[0] == k[1]).any())
    assert found >= 297


def test_signatures_agree_as_often_as_sets_are_alike():
    r = np.random.default_rng(6)
    for n in (30, 100, 400):
        same = []
        for _ in range(60):
            x = r.integers(0, 2**63, n, dtype=np.uint64)
            y = x.copy()
            y[: n // 5] = r.integers(0, 2**63, n // 5, dtype=np.uint64)  # similarity (n - n/5) / (n + n/5)
            a, b = (ln.signatures(ln.mix(z), np.array([0, n]))[0] for z in (x, y))
            same.append((a == b).mean())
        assert abs(np.mean(same) - 2 / 3) < 0.05


def test_against_all_pairs(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame([(*x, 7, "clash") for x in docs], "doc_id long, text string, number int, line string")
    want = brute(docs)
    assert sum(not x[-1] for x in want) > 100 and any(x[-1] is False and x[:2] != x[2:4] for x in want)
    for block, pairs in ((1024, ln.PAIRS), (2, 0)):
        monkeypatch.setattr(ln, "BLOCK", block)
        monkeypatch.setattr(ln, "PAIRS", pairs)
        got = [tuple(r) for r in ln.line_report(frame).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        kept = {r.doc_id: r.text for r in ln.dedup_lines(frame).select("doc_id", "text").collect()}
        for i, t in docs:
            stay = {n for d, n, _, _, k in want if d == i and k}
            assert kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n in stay))
    assert ln.dedup_lines(frame).columns == frame.columns


def test_one_changed_character_on_ordinary_lines(spark):
    """Planted edits on lines of 20 to 80 characters; whether a line is near another is known from the edit, not from shingles."""
    r = random.Random(21)
    rows, length = [], {}
    for i in range(600):
        n = 20 + i % 60
        x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n - 2))
        x = "q" + x + "z"
        at = r.randrange(n)
        rows += [(i, x), (1000 + i, x[:at] + r.choice("XYZ") + x[at + 1 :])]
        length[1000 + i] = n
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keeper = {x.doc_id: x.keeper_doc_id for x in ln.line_report(frame).collect()}
    assert all(keeper[i] == i for i in range(600))  # lines that weren't planted as copies stay
    found = lambda lo, hi: np.mean([keeper[i] == i - 1000 for i, n in length.items() if lo <= n < hi])
    assert found(40, 60) > 0.95 and found(60, 80) > 0.98
    # on shorter lines a change in the middle alone takes them below SIMILARITY
    assert found(20, 40) > 0.15


def test_sketches_rule_out_no_line_that_is_alike():
    """Short kind: never. Long kind: hardly ever. Lines that aren't alike are mostly ruled out."""
    r = np.random.default_rng(3)
    for n, kind in ((30, 0), (60, 0), (80, 0), (200, 1), (600, 1)):
        alike, other = [], []
        for _ in range(300):
            x = r.integers(0, 2**63, n, dtype=np.uint64)
            y = x.copy()
            y[: n // 9] = r.integers(0, 2**63, n // 9, dtype=np.uint64)  # similarity 0.8 or a little more
            z = np.r_[x[: n // 3], r.integers(0, 2**63, n - n // 3, dtype=np.uint64)]  # similarity 0.2
            hashes = ln.mix(np.concatenate([x, y, z]))
            keys, whose, sketch = ln.posted_keys(hashes, np.arange(4) * n)
            at = [np.flatnonzero((whose == i) & (keys & np.uint64(1) == kind))[0] for i in range(3)]
            near = ln.may_be_alike(np.full(3, kind == 1), sketch[at])(np.zeros(2, int), np.array([1, 2]))
            alike.append(near[0])
            other.append(near[1])
        assert np.mean(alike) == 1 if kind == 0 else np.mean(alike) > 0.99
        assert np.mean(other) < 0.02


def test_large_buckets_and_large_groups(spark, monkeypatch):
    """Postings that don't fit a task's hold, and groups over BLOCK, give the same links."""
    r = random.Random(7)
    base = "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(150))
    rows = []
    for i in range(300):
        at = r.randrange(150)
        rows.append((i, base[:at] + "Z" + base[at + 1 :] if i % 3 else "".join(r.choice("abcdefghijk ") for _ in range(150))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, ln.line_report(frame).collect()))
    monkeypatch.setattr(ln, "HELD", 64)
    monkeypatch.setattr(ln, "BUCKETS", 1)
    monkeypatch.setattr(ln, "BLOCK", 32)
    assert sorted(map(str, ln.line_report(frame).collect())) == whole
    assert sum("kept=True" in x for x in whole) == 101


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "one line here\nb", "x", 1, 2)] * 2 + [(2, "one line here", "y", 3, 4)], "doc_id long, text string, gone string, _gone int, gone_rid int")
    got = ln.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "one line here\nb", "x", 1, 2)] * 2 + [(2, "", "y", 3, 4)]


def test_a_text_of_many_lines(spark):
    """Taking lines out is linear in their number."""
    r = random.Random(2)
    lines = ["".join(r.choice("abcdefghijklmnop ") for _ in range(12)).strip() for _ in range(30_000)]
    text = "\n".join(lines[i // 2] if i % 50 else "" for i in range(60_000))
    got = ln.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text.split("\n")
    assert [x for x in got if x] == list(dict.fromkeys(x for x in text.split("\n") if x)) and got.count("") == 1200


def test_equal_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "same line here", 14)] * 2 + [(2, "same line here\nother", 20)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in ln.dedup_lines(docs).collect()) == [(1, "same line here", 14)] * 2 + [(2, "other", 5)]
    assert ln.line_report(docs.limit(0)).count() == 0 and ln.dedup_lines(docs.limit(0)).count() == 0
