"""Language-model scoring by a causal self-attention model over subword ids.

Training documents give, over all of them, the counts of words (for the base score), of subword ids and of neighbouring ids; the
counts of neighbours are part of the model, and grow with the corpus. The attention weights on top of them are trained on every id of every
training document, in one pass of ROUNDS rounds: documents are dealt to rounds by hash, each task trains on all its own of the round from the
weights before it, and the tasks' weights are averaged. Documents are scored in overlapping windows, each token once.

Subwords are ids of a published vocabulary, found from left to right by longest match (one pass of an automaton, so that new words cost no more than known ones); the TOP
most frequent ids of the corpus are kept, the others spelled by the vocabulary's single symbols, so that any text has a probability. Words of the base score are known by 64-bit hashes: counts of the TOP_WORDS most frequent go to every task,
the others are joined by shuffle.

Texts are lower-cased (A-Z only). Defined cases: null text is empty and is one end token; a null doc_id is not held out; repeated rows are
scored each; without training documents every count is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.attention import RATE, S, T, Attention, windows
from cairn.llm.bpe import END as MARKED
from cairn.llm.bpe import vocabulary
from cairn.llm.common import checkpoint
from cairn.llm.substring import _spans, keyed, portions, words_of

TOP, TOP_WORDS = 1536, 1 << 17
#: Rounds of training (each document is in one of them), and tasks that sum up what a round's tasks have learned.
ROUNDS, SUMMED = 4, 8
#: Tokens that a training task should have in a round: of fewer its weights hardly leave those it began with, and their average stays behind.
ENOUGH = 250_000
#: The weights that have a row for each token.
OF_TOKENS = "qkvr"
#: Tokens of whole documents whose windows are mixed while training.
MIXED = 1 << 16
#: Stands for the end of a text among the vocabulary's ids (which are below).
END = 0xFFFF
#: Counts that a task holds before it hands them on.
COUNTED = 1_000_000
SYMBOLS = 512
#: A byte that no UTF-8 text has, put after every word.
BREAK, MARK = b"\xff", "\xff"
_SECOND = itemgetter(1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def lower(raw: np.ndarray) -> np.ndarray:
    return raw + np.uint8(32) * ((raw >= 65) & (raw <= 90)).astype(np.uint8)


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def prepare(rows: DataFrame, path: str) -> DataFrame:
    """One pass over the texts: kind 0, each document's ids; kinds 1 and 2, counts of word hashes and of id pairs in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = subwords(path)
        words, pairs = ([], []), ([], [])
        names, kinds = ("kind", "id", "rid", "held_out", "ids", "counts"), (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def counted() -> pa.RecordBatch:
            out = []
            for kind, (keys, counts), t in ((1, words, np.uint64), (2, pairs, np.uint32)):
                k, c = _sum(keys, counts)
                out.append((kind, None, None, None, k.astype(t).tobytes(), c.tobytes()))
                keys.clear()
                counts.clear()
            return batch_of(out)

        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held = batch.column(2).to_numpy(zero_copy_only=False)
            docs: list[bytes] = []
            for lo, hi, raw, at in portions(batch, 3):
                raw = lower(raw)
                starts, ends, first = words_of(raw, at)
                u, inverse = np.unique(_spans(raw, starts, ends), return_inverse=True)
                body = raw.tobytes()
                said = [v.encode(body[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                docs += [x.tobytes() for x in said]
                tokens, cut = np.concatenate(said), np.r_[0, np.cumsum([len(x) for x in said])]
                train = ~held[lo:hi]
                count = np.bincount(inverse[np.repeat(train, np.diff(first))], minlength=len(u))
                words[0].append(u[count > 0])
                words[1].append(count[count > 0])
                # each text's ids with the end before and after
                seq = np.insert(tokens, cut[1:], END)
                whose = np.repeat(train, np.diff(cut) + 1)
                before = np.r_[np.uint16(END), seq[:-1]].astype(np.uint32)
                k, c = np.unique((before << np.uint32(16) | seq)[whose], return_counts=True)
                pairs[0].append(k)
                pairs[1].append(c)
            if docs:
                yield batch_of([(0, *x) for x in zip(ids.tolist(), rids.tolist(), held.tolist(), docs, [None] * len(docs), strict=True)])
            if sum(map(len, words[0])) > COUNTED:
                yield counted()
        if words[0]:
            yield counted()

    rows = rows.select("id", "rid", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "kind int, id long, rid long, held_out boolean, ids binary, counts binary")


def _counts(prepared: DataFrame, kind: int, dtype: type) -> DataFrame:
    """key, n: the counts of one kind, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(keys, dtype).astype(np.uint64).view(np.int64)), pa.array(np.frombuffer(counts, np.int64))], ["key", "n"])

    return prepared.filter(F.col("kind") == kind).select("ids", "counts").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Subwords:
    """Longest matches over a vocabulary's tokens, as strings with a character for each byte; MARK stands for a word's end."""

    def __init__(self, path: str):
        v = vocabulary(path)
        byte_of = {c: chr(i) for i, c in enumerate(v.bytes)}
        self.tokens = ahocorasick.Automaton()
        self.spelled: list[list[int]] = [[0]] * END
        for form, i in v.id_of.items():
            last = ord(form[-1])
            plain = form if last < MARKED else form[:-1] + chr(last - MARKED)
            if all(c in byte_of for c in plain):
                self.tokens.add_word("".join(byte_of[c] for c in plain) + (MARK if last >= MARKED else ""), i)
                self.spelled[i] = [v.id_of[c] for c in form]
        self.tokens.make_automaton()

    def encode(self, text: bytes) -> np.ndarray:
        """text: lower-cased UTF-8."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint16)
        return np.fromiter(map(_SECOND, self.tokens.iter_long((BREAK.join(words) + BREAK).decode("latin-1"))), np.uint16)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Spelling:
    """The model's tokens: the symbols (ids under SYMBOLS), the kept ids, and the end, the last. Other ids are spelled."""

    def __init__(self, kept: np.ndarray, path: str):
        every = subwords(path).spelled
        self.end = SYMBOLS + len(kept)
        own = np.full(END + 1, -1)
        own[:SYMBOLS], own[kept], own[END] = np.arange(SYMBOLS), SYMBOLS + np.arange(len(kept)), self.end
        spelled = [[own[i]] if own[i] >= 0 else every[i] for i in range(END + 1)]
        self.size = np.array([len(x) for x in spelled])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(spelled).astype(np.int32)

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        out = np.cumsum(n)
        return self.flat[np.arange(out[-1] if len(out) else 0) + np.repeat(self.at[ids] - (out - n), n)]


def fit(prepared: DataFrame, path: str) -> tuple[Attention, Spelling]:
    """The model. What reaches the driver is bounded by the vocabulary's size, TOP and SUMMED."""
    spark = prepared.sparkSession
    pairs = checkpoint(_counts(prepared, 2, np.uint32))
    single = pairs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("id")).agg(F.sum("n").alias("n")).filter((F.col("id") >= SYMBOLS) & (F.col("id") < END))
    kept = np.array(sorted(r.id for r in single.orderBy(F.desc("n"), "id").limit(TOP).collect()), np.int64)
    spelling = Spelling(kept, path)
    every = {r.id: r.n for r in single.collect()}  # at most the vocabulary
    ends = [(i, int(spelling.flat[spelling.at[i]]), int(spelling.flat[spelling.at[i] + spelling.size[i] - 1])) for i in range(END + 1)]
    ends = F.broadcast(spark.createDataFrame(ends, "id int, head int, tail int"))  # one row for each id
    own = pairs.withColumn("a", F.shiftright("key", 16).cast("int")).withColumn("b", F.col("key").bitwiseAND(0xFFFF).cast("int"))
    own = own.join(ends.select(F.col("id").alias("a"), F.col("tail").alias("last")), "a").join(ends.select(F.col("id").alias("b"), F.col("head").alias("next")), "b")
    counted = own.groupBy("last", "next").agg(F.sum("n").alias("n")).toArrow()  # at most the square of the model's tokens
    table = np.zeros((spelling.end + 1,) * 2)
    table[counted.column("last").to_numpy(), counted.column("next").to_numpy()] = counted.column("n").to_numpy()
    for i, n in every.items():
        word = spelling.flat[spelling.at[i] : spelling.at[i] + spelling.size[i]]
        np.add.at(table, (word[:-1], word[1:]), n)
    model = Attention(table)
    tasks = 1 + int(table.sum()) // (ROUNDS * ENOUGH)  # a partition more than this many is read together with others
    for step in range(ROUNDS):
        train_round(prepared, model, spelling, step, tasks)
    return model, spelling


def training_windows(model: Attention, spelling: Spelling, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as model tokens, each with its end -> all their windows: tokens before each place, and the classes of the scored places (else -1)."""
    tokens, first = np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])]
    at, begin = windows(first)
    place = at[:, None] + np.arange(S - T, S)
    before = np.r_[spelling.end, tokens[:-1]]
    before[first[:-1]] = spelling.end
    seen = np.where(place >= begin[:, None], before[np.clip(place, 0, len(tokens) - 1)], model.v)
    scored, stop = place[:, T - S :], first[np.searchsorted(first, begin, "right")]
    return seen, np.where(scored < stop[:, None], model.own[tokens[np.clip(scored, 0, len(tokens) - 1)]], -1)


def train_round(prepared: DataFrame, model: Attention, spelling: Spelling, step: int, tasks: int = 1 << 30) -> int:
    """Train the model's weights on all training documents of a round, in at most so many tasks; returns how many tokens (ends included) they had.

    A task's weights count by the tokens it has trained on, those of a token by how often the task has seen it.
    """
    sc = prepared.sparkSession.sparkContext
    shared = sc.broadcast((model.shared(), spelling.size, spelling.at, spelling.flat, spelling.end))
    rate = RATE * (1 - 0.95 * step / max(1, ROUNDS - 1))
    names = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, size, at, flat, end = shared.value
        net, words = Attention.of({k: w.copy() for k, w in weights.items()}), Spelling.__new__(Spelling)
        words.size, words.at, words.flat, words.end = size, at, flat, end
        moments: dict[str, np.ndarray] = {}
        portion: list[np.ndarray] = []
        times, held, part = np.zeros(net.v + 1), 0, None

        def close() -> None:
            seen, target = training_windows(net, words, portion)
            net.train(seen, target, moments, rate=rate)
            times[:] += np.bincount(seen.ravel(), minlength=net.v + 1)
            portion.clear()

        n = 0
        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows and part is None else part
            for ids in batch.column(1).to_pylist():
                portion.append(np.r_[words.tokens(np.frombuffer(ids, np.uint16)), end])
                held += len(portion[-1])
                if held > MIXED:
                    n, held = n + held, 0
                    close()
        if portion:
            n += held
            close()
        if n:
            learned = [net.p[k] * (times[:, None] if k in OF_TOKENS else n) for k in names]
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([times.tobytes()]), pa.array([np.concatenate([x.ravel() for x in learned]).tobytes()])], ["part", "n", "times", "learned"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, times, learned = 0, 0.0, 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                n += batch.column(1)[row].as_py()
                times = times + np.frombuffer(batch.column(2)[row].as_py())
                learned = learned + np.frombuffer(batch.column(3)[row].as_py())
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([times.tobytes()]), pa.array([learned.tobytes()])], ["n", "times", "learned"])

    docs = prepared.filter("kind = 0 and not held_out").filter(F.pmod(F.xxhash64("id", "rid"), F.lit(ROUNDS)) == step)
    docs = docs.select("ids").coalesce(tasks).select(F.spark_partition_id().alias("part"), "ids")
    sums = docs.mapInArrow(run, "part int, n long, times binary, learned binary").repartition(SUMMED, "part").sortWithinPartitions("part")
    rows = checkpoint(sums.mapInArrow(add, "n long, times binary, learned binary")).collect()
    shared.unpersist()
    if not rows:
        return 0
    n, times, learned = sum(r.n for r in rows), sum(np.frombuffer(r.times) for r in rows), sum(np.frombuffer(r.learned) for r in rows)
    at = 0
    for k in names:
        was = model.p[k]
        count = times[:, None] if k in OF_TOKENS else np.full((1,) * was.ndim, n)
        new = learned[at : at + was.size].reshape(was.shape) / np.maximum(count, 1)
        model.p[k] = np.where(count > 0, new, was).astype(np.float32)
        at += was.size
    return n


def model_scores(prepared: DataFrame, model: Attention, spelling: Spelling) -> DataFrame:
    """id, rid, score: log10 probability of every distinct row's text."""
    shared = prepared.sparkSession.sparkContext.broadcast((model.weights(), spelling.size, spelling.at, spelling.flat, spelling.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, size, at, flat, end = shared.value
        net, words = Attention.of(weights), Spelling.__new__(Spelling)
        words.size, words.at, words.flat, words.end = size, at, flat, end
        for batch in batches:
            scores: list[np.ndarray] = []
            portion: list[np.ndarray] = []
            held = 0

            def close() -> None:
                first = np.r_[0, np.cumsum([len(x) for x in portion])]
                scores.append(np.add.reduceat(net.log_probs(np.concatenate(portion), first, end), first[:-1]))
                portion.clear()

            for ids in batch.column(2).to_pylist():
                portion.append(np.r_[words.tokens(np.frombuffer(ids, np.uint16)), end])
                held += len(portion[-1])
                if held > 1 << 17:
                    close()
                    held = 0
            if portion:
                close()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0), *scores]))], ["id", "rid", "score"])

    docs = prepared.filter("kind = 0").select("id", "rid", "ids")
    return docs.mapInArrow(run, "id long, rid long, score double").groupBy("id", "rid").agg(F.first("score").alias("score"))


def base_scores(rows: DataFrame, counts: DataFrame, n_train: int) -> DataFrame:
    """id, rid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score for every row. counts: key, n."""
    spark = rows.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + n_train, distinct + (n_train > 0)
    # the least count that at most TOP_WORDS words reach, to a quarter of a power of two: a few rows, where a sort's limit would gather many
    step = F.floor(F.log2("n") * 4).cast("int")
    least, many = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        many += r["count"]
        if many > TOP_WORDS:
            break
        least = r.step
    top = counts.filter(step >= least).toArrow()
    order = np.argsort(key := top.column("key").to_numpy())
    shared = spark.sparkContext.broadcast((key[order].copy(), np.log10(top.column("n").to_numpy()[order] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = shared.value
        for batch in batches:
            for lo, hi, raw, at in portions(batch, 4):
                raw = lower(raw)
                starts, ends, first = words_of(raw, at)
                u, inverse = np.unique(_spans(raw, starts, ends), return_inverse=True)
                u = u.view(np.int64)
                i = np.minimum(np.searchsorted(keys, u), max(len(keys) - 1, 0))
                hit = keys[i] == u if len(keys) else np.zeros(len(u), bool)
                log = np.where(hit, logs[i], 0) if len(keys) else np.zeros(len(u))
                sums, hits = np.r_[0, np.cumsum(log[inverse])], np.r_[0, np.cumsum(hit[inverse])]
                rest = np.flatnonzero(~hit[inverse])
                rare = pa.ListArray.from_arrays(np.searchsorted(rest, first).astype(np.int32), u[inverse[rest]])
                yield pa.record_batch([batch.column(c).slice(lo, hi - lo) for c in range(4)] + [pa.array(np.diff(first)), pa.array(np.diff(hits[first])), pa.array(np.diff(sums[first])), rare], ["doc_id", "id", "rid", "held_out", "words", "known", "logs", "rare"])

    rows = rows.select("doc_id", "id", "rid", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = rows.mapInArrow(run, "doc_id long, id long, rid long, held_out boolean, words long, known long, logs double, rare array<long>")
    found = checkpoint(found.withColumn("row", F.monotonically_increasing_id()))  # written, so that row numbers hold
    rare = found.select("row", F.explode("rare").alias("key")).join(counts, "key")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more_logs"), F.count(F.lit(1)).alias("more_known"))
    end = float(np.log10(n_train + 1.0))
    out = found.drop("rare").join(rare, "row", "left")
    n = F.col("words") + 1
    return out.select(
        "doc_id", "id", "rid", "held_out", n.alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(n_train > 0)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end - n * float(np.log10(total + distinct + 1.0))).alias("base_score"),
    )


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. path: the vocabulary file, present on every machine."""
    rows = keyed(docs)
    prepared = checkpoint(prepare(rows, path))
    model, spelling = fit(prepared, path)
    n_train = prepared.filter("kind = 0 and not held_out").count()
    base = base_scores(rows, checkpoint(_counts(prepared, 1, np.uint64)), n_train)
    both = base.join(model_scores(prepared, model, spelling), ["id", "rid"])
    return both.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
