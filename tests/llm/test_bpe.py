import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import bpe
from cairn.llm.queries import WORD_BPE

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="the vocabulary file is not here")
LIBRARY = Tokenizer.from_file(WORD_BPE) if os.path.exists(WORD_BPE) else None
HARD = ["", " ", "it's I'LL", "İstanbul ΣΑΣ ß", "12½ 你好", "a<|endoftext|>b <|startoftext|>", "<|END", "é x", "naïve\x85\x1c\x1fé", "x" * 5000, "the " * 3000, "\U0001f600!!\n\t…“q”"]


def same(text):
    v = bpe.vocabulary(WORD_BPE)
    e = LIBRARY.encode(text, add_special_tokens=False)
    ids = v.encode(text)
    assert ids.tolist() == e.ids
    assert v.decode(ids) == LIBRARY.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeéèÉİßthing '.!<|1\nͅΣ", max_size=60))
def test_letters(text):
    same(text)


def test_a_store_that_overflows_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    v = bpe.Vocabulary(WORD_BPE)
    text = " ".join(f"word{i % 70} {'long' * (i % 90)}" for i in range(800))
    assert v.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert v.held < 400 + bpe.PIECE + 2 * bpe.LONG


def test_a_very_long_text():
    same("an unbroken" * 40_000 + " and many words " * 40_000)


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    got = bpe.digests(bpe.encode(docs, WORD_BPE)).collect()
    want = []
    for i, t in rows:
        e = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode(docs.limit(0), WORD_BPE).count() == 0
