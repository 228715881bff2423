import itertools
import random
import re

from cairn.llm import decontaminate as dc


def tok(text):
    return [t for t in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if t]


def brute(docs, items):
    """Every offset, every window."""
    by = {}
    for i, t in items:
        w = tuple(tok(t))
        if w:
            by[w] = min(i, by.get(w, i))
    out = set()
    for d, t in docs:
        x = tok(t)
        for w, i in by.items():
            width = min(dc.WINDOW, len(w))
            for o in range(-len(w), len(x)):
                a, b = max(o, 0), max(-o, 0)
                same = [p == q for p, q in zip(x[a:], w[b:], strict=False)]
                if any(sum(same[s : s + width]) >= (width if width < 8 else -(-width * 4 // 5)) for s in range(len(same) - width + 1)):
                    out.add((d, i))
    return out


def test_masks_find_every_window_with_up_to_three_substitutions():
    free = [frozenset(c) for k in range(4) for c in itertools.combinations(range(dc.WINDOW), k)]
    for changed in free:
        assert any(not changed & {s + i for i, c in enumerate(m) if c == "1"} for m in dc.MASKS for s in range(dc.WINDOW - len(m) + 1))


def test_masks_of_short_items_find_every_match():
    for m in range(1, dc.WINDOW):
        for k in range(m - dc.required(m) + 1):
            for changed in itertools.combinations(range(m), k):
                assert any(all(c == "0" or i not in changed for i, c in enumerate(x)) and "1" in x and len(x) == m for x in dc.masks(m))


def test_short_items(spark):
    """Items of 1 to 14 tokens, whole, with as many substitutions as they may have, and with one more."""
    r = random.Random(6)
    items, docs = [], []
    say = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    for m in range(1, 15):
        w = say(m)
        items.append((m, " ".join(w)))
        for k in range(m - dc.required(m) + 2):
            x = list(w)
            for p in r.sample(range(m), min(k, m)):
                x[p] = "other"
            docs.append((100 * m + k, " ".join([*say(r.randrange(6)), *x, *say(r.randrange(6))])))
    items.append((50, "what is the capital city of france"))
    docs += [(5000, "xx what is the capital city of france yy zz"), (5001, "xx what was the capital city of france yy zz")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert (5000, 50) in want and (5001, 50) not in want and len(want) > 20
    for most in (dc.BROADCAST_BYTES, 0):
        got = dc.overlaps(d, b, most).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)


def data(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(r.choice([15, 20, 40]))) for i in range(12)] + [(12, "too short to count"), (13, None), (14, "")]
    items += [(15, items[3][1]), (3, items[3][1])]
    docs = []
    for d in range(120):
        w = say(r.randint(0, 150)).split()
        if d % 3 == 0:
            passage = tok(r.choice(items[:12])[1])
            for p in r.sample(range(len(passage)), d % 5 * len(passage) // 20):
                passage[p] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = passage
        docs.append((d, ", ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (502, items[0][1].split(" ", 1)[1]), (None, items[1][1])]
    return docs, items


def test_against_every_alignment(spark):
    docs, items = data(spark)
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, item_id int, seed string")
    b = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    for most in (10**6, 0):  # broadcast, and the join by shuffle
        got = dc.overlaps(d, b, most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(dc.LEAST <= r.n_equal <= r.n_tokens == dc.WINDOW for r in got)
    kept = dc.decontaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {x for x, _ in want})
    assert dc.overlaps(d.limit(0), b).count() == 0 and dc.overlaps(d, b.limit(0)).count() == 0
    assert dc.decontaminated(d, b.limit(0)).count() == len(docs)
