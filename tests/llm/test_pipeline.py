import os

import numpy as np
import pytest

import corpus_pipeline as p
from cairn.llm import bpe, lines, simhash
from cairn.llm.queries import WORD_BPE

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="the vocabulary file is not here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, junk, repeated lines, copies, near copies, a leak."""
    d = str(tmp_path_factory.mktemp("tables"))
    r = np.random.default_rng(3)
    words = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ir", "o")]
    say = lambda n: " ".join("".join(r.choice(words, 3)) for _ in range(n))
    item = say(30)
    rows = [(i, say(int(r.integers(30, 120))) if i % 4 else "!! ".join(say(40).upper().split()) + "!!") for i in range(400)]
    long = rows[1][1]
    shared = say(25)
    rows += [(500, long), (501, long.replace(" ", "  ", 1)), (502, say(40) + " " + item + " " + say(20)), (503, say(60) + "\n" + shared), (504, say(60) + "\n" + shared + "\n" + say(50)), (505, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, folder)
        if i < len(p.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    good = {i for i in range(400) if i % 4}
    assert good <= set(seen["quality"]) and not {i for i in range(0, 400, 4)} & set(seen["quality"])
    text = {i: r.text for i, r in seen["lines"].items()}
    assert set(text) == set(seen["quality"]) and text[1] and text[500] == "" and text[501] == ""
    assert "\n" in text[503] and text[504].count("\n") == 1
    assert {500, 501} & set(seen["near_copies"]) in ({500}, {500, 501} - {501}) and 1 in seen["near_copies"]
    assert 502 in seen["near_copies"] and 502 not in seen["benchmark"] and set(seen["near_copies"]) - {502} == set(seen["benchmark"])
    v = bpe.Vocabulary(WORD_BPE)
    assert {i: list(r.ids) for i, r in seen["tokens"].items()} == {i: v.encode(r.text or "").tolist() for i, r in seen["benchmark"].items()}
    whole = {r.doc_id: r.n_tokens for r in p.run(spark, folder).collect()}
    assert whole == {i: r.n_tokens for i, r in seen["tokens"].items()}


def test_stages_are_their_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(map(str, p.STAGES[1][1](spark, docs, folder).collect())) == sorted(map(str, lines.dedup_lines(docs).collect()))
    assert sorted(map(str, p.STAGES[2][1](spark, docs, folder).collect())) == sorted(map(str, simhash.keep_one(docs).collect()))


def test_names():
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_copies", "benchmark", "tokens"]
