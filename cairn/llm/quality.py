"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte is a learned code plus one bit that says
whether the four bytes from it on occurred just before; learned filters run over that, neighbouring answers are averaged, second filters
run over the averages, each filter's greatest answer in a chunk is kept (max-pooling), and the mean and the greatest over all chunks give
one probability. Scores see bytes only: never labels, languages, sources or ids.

Training takes at most PER_CLASS labelled documents of each class (the least hashes of their ids; of several texts under one id the least hash's;
texts over LONGEST bytes aren't taken) and every chunk of each: a bounded sample, as documented parameters. Scoring reads every byte.

Scores come from the trained weights rounded to whole numbers, so small that every sum up to the last layer is exact in float32 whatever its
order; the last layer adds in a fixed order. So a text's score depends on its bytes alone, not on what shares its batch, on threads or on machines.

Defined cases: null text is empty and scored like any text (no byte: all padding); equal texts score equally, bit for bit; a very long text is
worked on in portions of chunks, and its score is over all of them; without labels of both classes every score is the
share of label 1 (0.5 without labels); a document with several labels has their mean, rounded; labels without documents and documents
without labels are fine; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import id_text, small_batches, utf8

CHUNK, STEP = 512, 448
CODE, WIDTH, STRIDE, FILTERS = 6, 16, 4, 16
POOL, POOL_STEP, SECOND = 8, 4, 16
PER_CLASS, LONGEST = 1000, 1 << 20
#: Chunks worked on at once.
PART = 128
#: Whole numbers up to these stand for codes and weights, and for what the second filters read; sums stay below EXACT.
LEVELS, LEVELS2, EXACT = 127, 4095, 1 << 24
THRESHOLD = 0.7
PLACES = (CHUNK - WIDTH) // STRIDE + 1
POOLED = (PLACES - POOL) // POOL_STEP + 1


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover n bytes; the last one ends where the text ends."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.r_[np.arange(0, n - CHUNK, STEP), n - CHUNK].astype(np.int64)


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that lie one after another -> start of every chunk, where its text ends, and each text's first chunk."""
    starts = [chunk_starts(int(b - a)) + a for a, b in zip(at[:-1], at[1:], strict=True)]
    n = [len(s) for s in starts]
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.repeat(at[1:], n), np.r_[0, np.cumsum(n, dtype=np.int64)]


def chunks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of CHUNK bytes, zero after the end."""
    where = starts[:, None] + np.arange(CHUNK)
    return np.where(where < ends[:, None], np.r_[raw, np.zeros(1, np.uint8)][np.minimum(where, len(raw))], 0).astype(np.uint8)


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every chunk of texts that lie one after another, and each text's first chunk."""
    starts, ends, first = placed(at)
    return chunks(raw, starts, ends), first


def repeats(x: np.ndarray) -> np.ndarray:
    """1 where four bytes occurred 2 to 24 bytes before too."""
    wide = x.astype(np.uint32)
    gram = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    out = np.zeros(x.shape, bool)
    for lag in range(2, 25):
        out[:, lag:-3] |= gram[:, lag:] == gram[:, :-lag]
    return out & (x != 0)


def _pooled(h: np.ndarray) -> np.ndarray:
    return sum(h[:, j : j + POOLED * POOL_STEP : POOL_STEP][:, :POOLED] for j in range(POOL))


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"code": f(256, CODE, by=0.5), "w1": f(WIDTH * (CODE + 1), FILTERS, by=0.12), "b1": np.zeros(FILTERS, np.float32), "w2": f(FILTERS, SECOND, by=0.3), "b2": np.zeros(SECOND, np.float32), "w3": f(2 * SECOND, by=0.2), "b3": np.zeros(1, np.float32)}

    def _seen(self, x: np.ndarray, code: np.ndarray, one: float) -> np.ndarray:
        """Chunks -> what the first filters read at each place."""
        seen = np.concatenate([code[x], repeats(x)[..., None].astype(np.float32) * np.float32(one)], axis=2)
        rows = np.lib.stride_tricks.as_strided(seen, (len(x), PLACES, WIDTH * (CODE + 1)), (seen.strides[0], seen.strides[1] * STRIDE, seen.strides[2]))
        return np.ascontiguousarray(rows).reshape(-1, WIDTH * (CODE + 1))

    def _filters(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Chunks -> each second filter's greatest answer."""
        p = self.p
        rows = self._seen(x, p["code"], 1)
        h1 = np.maximum(rows @ p["w1"] + p["b1"], 0).reshape(len(x), PLACES, FILTERS)
        mean = _pooled(h1) / np.float32(POOL)
        h2 = np.maximum(mean @ p["w2"] + p["b2"], 0)
        if keep is not None:
            keep |= {"x": x, "rows": rows, "h1": h1, "mean": mean, "h2": h2}
        return h2.max(axis=1)

    def round(self, sample: np.ndarray) -> dict[str, np.ndarray]:
        """The weights as whole numbers (in float32); sample: chunks that show how large the second filters' input gets."""
        p, levels = self.p, LEVELS
        while True:
            by_code, by_w1 = levels / max(1.0, float(np.abs(p["code"]).max())), levels / float(np.abs(p["w1"]).max())
            q = {"code": np.rint(p["code"] * by_code), "one": np.rint(by_code), "w1": np.rint(p["w1"] * by_w1), "b1": np.rint(p["b1"] * (by_code * by_w1))}
            if POOL * (np.abs(q["w1"]).sum(axis=0) * levels + np.abs(q["b1"])).max() < EXACT:
                break
            levels //= 2
        q = {k: np.asarray(v, np.float32) for k, v in q.items()}
        self.q = q
        peak = max([1.0, *(float(self._read(sample[i : i + PART]).max()) for i in range(0, len(sample), PART))])
        by_m, by_w2 = LEVELS2 / peak, LEVELS / float(np.abs(p["w2"]).max())
        unit = POOL * by_code * by_w1 * by_m * by_w2
        q |= {"by_m": np.float32(by_m), "w2": np.rint(p["w2"] * by_w2).astype(np.float32), "b2": np.clip(np.rint(p["b2"] * unit), -(EXACT >> 2), EXACT >> 2).astype(np.float32), "unit": np.float64(unit)}
        q |= {"w3": p["w3"].astype(np.float64), "b3": p["b3"].astype(np.float64)}
        return q

    def _read(self, x: np.ndarray) -> np.ndarray:
        q = self.q
        return _pooled(np.maximum(self._seen(x, q["code"], q["one"]) @ q["w1"] + q["b1"], 0).reshape(len(x), PLACES, FILTERS))

    def _exact(self, x: np.ndarray) -> np.ndarray:
        """Like _filters, in whole numbers."""
        q = self.q
        m = np.floor(np.minimum(self._read(x) * q["by_m"], np.float32(LEVELS2)))
        return np.maximum(m @ q["w2"] + q["b2"], 0).max(axis=1)

    def _texts(self, best: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.diff(first)[:, None].astype(np.float32)
        return np.concatenate([np.add.reduceat(best, first[:-1]) / n, np.maximum.reduceat(best, first[:-1])], axis=1)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text, by the rounded weights `q`; chunks go through in bounded portions."""
        q, n = self.q, len(at) - 1
        total, best = np.zeros((n, SECOND)), np.zeros((n, SECOND))
        starts, ends, first = placed(at)
        for i in range(0, len(starts), PART):
            found = self._exact(chunks(raw, starts[i : i + PART], ends[i : i + PART])).astype(np.float64)
            text = np.searchsorted(first, np.arange(i, i + len(found)), "right") - 1
            np.add.at(total, text, found)
            np.maximum.at(best, text, found)
        z = np.full(n, float(q["b3"][0]))
        for j in range(SECOND):
            z += total[:, j] / np.diff(first) * (float(q["w3"][j]) / float(q["unit"]))
            z += best[:, j] * (float(q["w3"][SECOND + j]) / float(q["unit"]))
        return np.array([1 / (1 + math.exp(-max(-700.0, v))) for v in z.tolist()])

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, kept = self.p, {}
        parts = [slice(i, i + 4 * PART) for i in range(0, len(x), 4 * PART)]
        best = np.concatenate([self._filters(x[s], kept if len(parts) == 1 else None) for s in parts])
        seen = self._texts(best, first)
        prob = 1 / (1 + np.exp(-(seen @ p["w3"] + p["b3"])))
        dz = ((prob - y) / len(y)).astype(np.float32)
        g = {"w3": seen.T @ dz, "b3": dz.sum(keepdims=True)}
        dseen, n = dz[:, None] * p["w3"], np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        top = (best == seen[text, SECOND:]).astype(np.float32)
        top /= np.add.reduceat(top, first[:-1])[text]  # chunks that tie share
        dbest = dseen[text, :SECOND] / n[text, None] + dseen[text, SECOND:] * top
        for s in parts:
            if len(parts) > 1:
                self._filters(x[s], kept)
            for k, d in self._back(x[s], kept, dbest[s]).items():
                g[k] = g[k] + d if k in g else d
        return g

    def _back(self, x: np.ndarray, kept: dict, dbest: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the filters and codes, from those of each chunk's answers."""
        p = self.p
        h2, mean, h1 = kept["h2"], kept["mean"], kept["h1"]
        dh2 = np.zeros_like(h2)
        np.put_along_axis(dh2, h2.argmax(axis=1)[:, None], dbest[:, None], axis=1)
        dh2 *= h2 > 0
        g = {"w2": mean.reshape(-1, FILTERS).T @ dh2.reshape(-1, SECOND), "b2": dh2.sum(axis=(0, 1))}
        dmean = dh2 @ p["w2"].T / np.float32(POOL)
        dh1 = np.zeros_like(h1)
        for j in range(POOL):
            dh1[:, j : j + POOLED * POOL_STEP : POOL_STEP][:, :POOLED] += dmean
        dh1 *= h1 > 0
        flat = dh1.reshape(-1, FILTERS)
        g |= {"w1": kept["rows"].T @ flat, "b1": flat.sum(axis=0)}
        dseen1 = (flat @ p["w1"].T).reshape(len(x), PLACES, WIDTH, CODE + 1)
        dx = np.zeros((len(x), CHUNK, CODE), np.float32)
        for j in range(WIDTH):
            dx[:, j : j + PLACES * STRIDE : STRIDE] += dseen1[:, :, j, :CODE]
        g["code"] = np.stack([np.bincount(x.ravel(), dx[..., d].ravel(), 256) for d in range(CODE)], axis=1).astype(np.float32)
        return g

    def train(self, texts: list[tuple[np.ndarray, int]], steps: int = 400, size: int = 48, rate: float = 4e-3, seed: int = 1) -> None:
        """texts: (chunks, label). Adam over batches with as many texts of either label, so that rare junk counts."""
        r, m, v = np.random.default_rng(seed), {}, {}
        sides = [[i for i, (_, y) in enumerate(texts) if y == side] for side in (0, 1)]
        for step in range(1, steps + 1):
            batch = np.concatenate([r.choice(s, size // 2) for s in sides])
            x = np.concatenate([texts[i][0] for i in batch])
            first = np.r_[0, np.cumsum([len(texts[i][0]) for i in batch])]
            y = np.array([texts[i][1] for i in batch], np.float32)
            for k, d in self._gradients(x, first, y).items():
                d = d + 1e-4 * self.p[k]
                m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                self.p[k] = (self.p[k] - rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def held_out(doc_id):
    """Rows that training never sees."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | float:
    """The network, or the share of label 1 where there aren't both labels."""
    said = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("double").alias("q")).filter("id is not null and q is not null")
    said = said.filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("q") >= 0.5).cast("int").alias("y"))
    chosen = [said.filter(F.col("y") == side).orderBy(F.xxhash64("id"), "id").limit(per_class) for side in (0, 1)]

    ids = chosen[0].union(chosen[1])  # at most twice per_class rows
    rows = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == ids["id"]).filter(F.octet_length("text") <= LONGEST)
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")).collect()
    texts = []
    for r in sorted(rows, key=lambda r: r.id):
        raw = r.text.encode()
        texts.append((cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0], r.y))
    if len({y for _, y in texts}) < 2:
        return float(np.mean([y for _, y in texts])) if texts else 0.5
    net = Network()
    net.train(texts)
    net.q = net.round(np.concatenate([x for x, _ in texts[:: max(1, len(texts) // 400)]]))
    return net


def scorer(model: Network | float) -> Callable[[pa.Array], np.ndarray]:
    """What gives a text column's scores; it goes to the tasks."""
    weights = model.q if isinstance(model, Network) else float(model)

    def scores(column: pa.Array) -> np.ndarray:
        if isinstance(weights, float):
            return np.full(len(column), weights)
        net = Network.__new__(Network)
        net.q = weights
        return net.scores(*utf8(column))

    return scores


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score for every row."""
    scores = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(scores(b.column(1)), pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that are predicted 1, by a model trained on `labelled` (or docs itself)."""
    scores = scorer(train(labelled if labelled is not None else docs, labels))
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).fill_null("")) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
