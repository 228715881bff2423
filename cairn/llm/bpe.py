"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one vocabulary token can end it in the piece's BPE encoding. An automaton over all token
strings reports, at each position, the tokens that are suffixes of the prefix, longest first; the one whose left neighbour
(the last token of the shorter prefix) is compatible with it is stored, and back-pointers from the end give the ids. Two tokens
are compatible if the merges leave their concatenation as these two; the answers are remembered per pair.

A piece is what the vocabulary file's normaliser and splitter leave: text between special tokens, NFC, white space to blanks,
lower case by code point, then the letters/number/other split. Pieces of Latin text are found by one pattern; a text with any
other character goes through the library's own normaliser and splitter, so that both read Unicode alike.

Defined cases: null and empty texts have no tokens and decode to empty text; the strings of special tokens inside a text become
their ids; a very long text is encoded whole, its pieces one by one, in memory of some 60 bytes for each of its own; the automaton leaves no ties; repeated rows are encoded each; null ids pass
through; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import id_text

#: Where a piece ends, the last symbol is another one: its character is moved by this much, and by none elsewhere.
END = 0x8000
#: What a worker process keeps of known pieces, in characters and ids, twice: a full store becomes the old one, from which what is met again returns.
#: A piece counts PIECE more for its entry; pieces over LONG characters aren't kept.
REMEMBERED, PIECE, LONG = 4_000_000, 24, 256
ROWS = 256
#: Two ids, or a rank and an id, share a number: an id has this many bits.
BITS = 24
#: Above every merge's rank.
NEVER = 1 << 62

#: Code points that NFC leaves alone and that both libraries class and lower-case alike.
PLAIN = r"\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u2030-\u205e\u20ac"


def split_pattern() -> re.Pattern:
    """The vocabulary file's split (contractions; letters; one number; others), its classes written out for plain code points."""
    classed = {"L": "", "N": ""}
    for c in filter(re.compile(f"[{PLAIN}]").match, map(chr, range(0x20AD))):
        kind = unicodedata.category(c)[0]
        if kind in classed:
            classed[kind] += re.escape(c)
    letter, number = classed["L"], classed["N"]
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\t-\r \x85\xa0{letter}{number}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where printable, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _symbols(piece: str) -> str:
    return piece[:-1] + chr(ord(piece[-1]) + END)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.path, self.library = path, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        form = lambda t: _symbols(t.removesuffix(self.suffix)) if self.suffix and t.endswith(self.suffix) and t != self.suffix else t
        self.id_of = {form(t): i for t, i in model["vocab"].items()}
        self.text_of = {i: t for t, i in self.id_of.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # pair of ids -> rank and the merged id, in one number each
        self.rank = {self.id_of[form(a)] << BITS | self.id_of[form(b)]: r << BITS | self.id_of[form(a + b)] for r, (a, b) in enumerate(merges)}
        self.suffixes = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.suffixes.add_word(t, (len(t), i))
        self.suffixes.make_automaton()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.plain, self.pieces = re.compile(f"[{PLAIN}]*"), split_pattern()
        self.bytes = byte_characters()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def merged(self, symbols: str) -> list[int]:
        """The merges applied by rank, leftmost first: the definition that pairs are tested by."""
        ids, rank = [self.id_of[c] for c in symbols], self.rank
        while len(ids) > 1:
            best, at, left = NEVER, 0, ids[0]
            for i in range(1, len(ids)):
                right = ids[i]
                if (r := rank.get(left << BITS | right, NEVER)) < best:
                    best, at = r, i
                left = right
            if best == NEVER:
                break
            ids[at - 1 : at + 1] = [best & ((1 << BITS) - 1)]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        key = left << BITS | right
        if (said := self.pairs.get(key)) is None:
            said = self.pairs[key] = self.merged(self.text_of[left] + self.text_of[right]) == [left, right]
        return said

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """piece: characters that stand for bytes, without the end mark."""
        symbols, pairs = _symbols(piece), self.pairs
        last, back = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        for end, (size, token) in self.suffixes.iter(symbols):  # at each end the longest first
            at = end + 1
            if last[at] < 0:
                start = at - size
                if start:
                    left = last[start]
                    if left < 0 or not (pairs[key] if (key := left << BITS | token) in pairs else self.compatible(left, token)):
                        continue
                last[at], back[at] = token, start
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at = back[at]
        return tuple(reversed(out))

    def _remember(self, piece: str) -> tuple[int, ...]:
        out = self.old.get(piece) or self.encode_piece(piece if piece.isalpha() and piece.isascii() else "".join([self.bytes[b] for b in piece.encode()]))
        if len(piece) <= LONG:
            if self.held >= REMEMBERED:
                self.old, self.known, self.held = self.known, {}, 0
            self.known[piece] = out
            self.held += len(piece) + len(out) + PIECE
        return out

    def _ids(self, text: str) -> list[tuple[int, ...]]:
        if self.plain.fullmatch(text):
            get, make = self.known.get, self._remember
            return [get(p) or make(p) for p in self.pieces.findall(text.lower())]
        if self.library is None:  # only where a text needs it: it takes tens of MB
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self.encode_piece(p) for p, _ in found if p]

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        ids = chain.from_iterable([(self.special[p],)] if p in self.special else self._ids(p) for p in parts if p)
        return np.fromiter(chain.from_iterable(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: tokens as the vocabulary writes them, joined by blanks; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist() if i in names])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string, for every whole text. path: a vocabulary file present on every machine, or one given by SparkContext.addFile (its bare name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path if "/" in path else SparkFiles.get(path))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [v.encode(x) for x in part.column(1).to_pylist()]
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *ids])), pa.array([v.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
