"""A causal self-attention model over subword ids, trained and run in numpy.

P(next | text) = P(group of next | window) * P(class of next | window, group) * P(next | last token, class). The last factor comes from smoothed
counts of neighbouring tokens; the others are softmaxes, over groups of classes and over a group's classes, of those counts' log shares, corrected by
attention over the window: queries, keys and values are learned vectors of the tokens, scores have a learned bias by distance, and later
positions are masked. Every distribution sums to one over the whole vocabulary. A token costs the exps of the groups and of one group's
classes, not of all classes.
"""

from __future__ import annotations

import numpy as np

#: Positions in a window, and how many of them, the last, it scores: every token is scored once, with T - S to T - 1 tokens before it.
T, S = 32, 24
D, CLASSES = 8, 256
#: Groups of equally many classes, a power of two.
GROUPS = 16
#: What tokens that are followed alike are put into, for the smoothing of counts.
ALIKE = 192
BATCH = 256
#: The step's size at the beginning of training.
RATE = 3e-2
#: Columns of a token's row in the table that is read at every place; after a value stands a one, so that one product gives the weights' sum too.
KEY, QUERY, ADDED, VALUE, SUMMED = slice(D), slice(D, 2 * D), slice(2 * D, 3 * D), slice(3 * D, 4 * D), slice(3 * D, 4 * D + 1)
LEARNED = slice(4 * D)
#: The weights without a row for each token.
OF_ALL = ("near", "u", "w")


def _mix(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Witten-Bell: counts (last, next) mixed with a lower distribution by how many kinds follow."""
    kinds = np.count_nonzero(n, axis=1)[:, None] + 1.0
    return (n + kinds * lower) / (n.sum(axis=1, keepdims=True) + kinds)


def smoothed(pairs: np.ndarray) -> np.ndarray:
    """Counts (last, next) -> log P(next | last), backed off to tokens that are followed alike, to the single counts, and to all tokens alike."""
    n, v = pairs.astype(np.float64), len(pairs)
    single = _mix(n.sum(axis=0, keepdims=True), np.full((1, v), 1.0 / v))
    group = grouped(pairs.T, ALIKE)
    alike = np.zeros((int(group.max()) + 1, v))
    np.add.at(alike, group, n)
    return np.log(_mix(n, _mix(alike, single)[group]))


def grouped(pairs: np.ndarray, count: int = CLASSES, seed: int = 3) -> np.ndarray:
    """Tokens (columns) grouped by what they follow: k-means over the main directions of the pair counts."""
    v = len(pairs)
    count = min(count, v)
    row, col = pairs.sum(axis=1, keepdims=True) + 1.0, pairs.sum(axis=0, keepdims=True) + 1.0
    m = (pairs / np.sqrt(row * col)).astype(np.float32)
    r = np.random.default_rng(seed)
    basis = np.linalg.qr(m @ r.standard_normal((v, 24)).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(m @ (m.T @ basis))[0]
    x = m.T @ basis
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    weight = np.sqrt(col.ravel())
    centre = x[np.argsort(-weight, kind="stable")[:count]].copy()
    for _ in range(12):
        own = (x @ centre.T).argmax(axis=1)
        for k in range(count):
            if (mine := own == k).any():
                centre[k] = (x[mine] * weight[mine, None]).sum(axis=0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return (x @ centre.T).argmax(axis=1).astype(np.int64)


def halved(features: np.ndarray, parts: int = GROUPS) -> list[np.ndarray]:
    """Rows put into parts of equal size (to one row), by halves along the main direction of what is left."""

    def halves(rows: np.ndarray, parts: int) -> list[np.ndarray]:
        if parts == 1 or len(rows) < 2:
            return [rows]
        x = features[rows] - features[rows].mean(axis=0)
        rows = rows[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        return halves(rows[: len(rows) // 2], parts // 2) + halves(rows[len(rows) // 2 :], parts // 2)

    return halves(np.arange(len(features)), parts)


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of each row (up to a number), their exps and the exps' sums."""
    e = np.exp(z)
    sums = e @ np.ones((z.shape[1], 1), z.dtype)
    if len(z) and not (sums.min() > 1e-20 and sums.max() < 1e20):  # hardly ever
        z = z - z.max(axis=1, keepdims=True)
        e = np.exp(z)
        sums = e.sum(axis=1, keepdims=True)
    return z, e, sums


def windows(first: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that lie one after another (starts and the end) -> each window's first scored place, and its sequence's start."""
    n = np.diff(first)
    count = -(-n // S)
    seq = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count)
    return first[seq] + within * S, first[seq]


class Attention:
    def __init__(self, pairs: np.ndarray, seed: int = 0):
        self.v = len(pairs)
        self.log_pair = smoothed(pairs).astype(np.float32)
        own = np.unique(grouped(pairs), return_inverse=True)[1]
        share = np.zeros((self.v, int(own.max()) + 1))
        np.add.at(share.T, own, np.exp(self.log_pair.T, dtype=np.float64))
        # classes are numbered by group
        groups = halved((share / np.sqrt(share.sum(axis=0) + 1e-30)).T)
        self.group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        share = np.maximum(share[:, np.concatenate(groups)], 1e-30)
        self.own = np.argsort(np.concatenate(groups))[own]
        whole = np.add.reduceat(share, np.flatnonzero(np.diff(self.group, prepend=-1)), axis=1)
        self.log_group, self.log_share = np.log(whole).astype(np.float32), np.log(share / whole[:, self.group]).astype(np.float32)
        # what is left: P(next | last, class)
        self.log_pair -= np.log(share).astype(np.float32)[:, self.own]
        self._layout()
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        # one token more than the vocabulary: what lies before a text
        self.p = {"q": f(self.v + 1, D, by=0.3), "k": f(self.v + 1, D, by=0.3), "v": f(self.v + 1, D, by=0.3), "r": f(self.v + 1, D, by=0.1), "u": f(D, whole.shape[1], by=0.1), "w": f(D, share.shape[1], by=0.1), "near": np.linspace(-1, 1, T).astype(np.float32)}
        self.distance = np.arange(T)[None, :] - (np.arange(S)[:, None] + T - S)  # key minus query: 0 at the query itself
        self.late = np.where(self.distance > 0, np.float32(-1e9), np.float32(0))

    def _layout(self) -> None:
        """Groups by places for classes; a group with a class less has a place that is never likely."""
        size = np.bincount(self.group)
        within = np.arange(len(self.group)) - (np.cumsum(size) - size)[self.group]
        self.place = within.astype(np.int64)
        self.columns = np.full((len(size), size.max()), len(self.group))
        self.columns[self.group, within] = np.arange(len(self.group))
        padded = np.concatenate([self.log_share, np.full((self.v, 1), -1e9, np.float32)], axis=1)
        self.group_of = self.group[self.own].astype(np.uint8)
        self.by_group = padded[:, self.columns].reshape(self.v * len(size), -1)

    def shared(self) -> dict[str, np.ndarray]:
        """What training needs."""
        return self.p | {"log_group": self.log_group, "log_share": self.log_share, "own": self.own, "group": self.group}

    def weights(self) -> dict[str, np.ndarray]:
        return self.shared() | {"log_pair": self.log_pair}

    @classmethod
    def of(cls, w: dict[str, np.ndarray]) -> Attention:
        a = cls.__new__(cls)
        a.p = {k: w[k] for k in ("q", "k", "v", "r", "u", "w", "near")}
        a.log_pair, a.log_group, a.log_share, a.own, a.group, a.v = w.get("log_pair"), w["log_group"], w["log_share"], w["own"], w["group"], len(w["log_share"])
        a._layout()
        a.distance = np.arange(T)[None, :] - (np.arange(S)[:, None] + T - S)
        a.late = np.where(a.distance > 0, np.float32(-1e9), np.float32(0))
        return a

    def _table(self) -> np.ndarray:
        """A row for each token: key, query, what the last token adds, value, and a one."""
        p = self.p
        return np.concatenate([p["k"], p["q"], p["r"], p["v"], np.ones((len(p["v"]), 1), p["v"].dtype)], axis=1)

    def _attend(self, seen: np.ndarray, table: np.ndarray, keep: dict | None = None, careful: bool = False) -> np.ndarray:
        """(windows, T) token before each place -> what the last S places know of the text, (windows * S, D). careful: nothing too large goes into exp."""
        kind = table.dtype
        row = table.take(seen, axis=0)
        q, k, v = row[:, T - S :, QUERY] * kind.type(1 / np.sqrt(D)), row[..., KEY], row[..., SUMMED]
        a = q @ k.transpose(0, 2, 1)
        a += self.p["near"][np.minimum(self.distance, 0) + T - 1] + self.late
        if len(early := np.flatnonzero(seen[:, 0] == self.v)):
            a[early] -= np.where(seen[early] == self.v, np.float32(60), np.float32(0))[:, None, :]  # what lies before the text
        if careful:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        h = a @ v
        total = h[..., D:]
        if not careful and not (total.min() > 1e-30 and total.max() < 1e30):  # hardly ever
            return self._attend(seen, table, keep, True)
        h = h[..., :D] / total
        if keep is not None:
            a /= total
            keep |= {"q": q, "k": k, "v": v[..., :D], "a": a, "read": h.copy()}
        h += row[:, T - S :, ADDED]
        return h.reshape(-1, D)

    def _forward(self, seen: np.ndarray) -> np.ndarray:
        """(windows, T) token before each place -> log P(class) at the last S places."""
        last = np.minimum(seen[:, T - S :].reshape(-1), self.v - 1)
        h = self._attend(seen, self._table())
        z, _, sums = _exps(h @ self.p["u"] + self.log_group[last])
        out = (z - np.log(sums))[:, self.group]
        for g in range(len(self.columns)):
            mine = self.group == g
            z, _, sums = _exps(h @ self.p["w"][:, mine] + self.log_share[last][:, mine])
            out[:, mine] += z - np.log(sums)
        return out.reshape(len(seen), S, -1)

    def _by_group(self) -> np.ndarray:
        """(groups, D, places): the classes' weights."""
        w = self.p["w"]
        return np.concatenate([w, np.zeros((D, 1), w.dtype)], axis=1)[:, self.columns].transpose(1, 0, 2).copy()

    def _levels(self, h: np.ndarray, last: np.ndarray, group: np.ndarray, w: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], np.ndarray]:
        """Rows in the order of their target's group -> logits, exps and sums over groups and over the classes of that group, and each group's first row."""
        last = np.minimum(last, self.v - 1)
        cut = np.searchsorted(group, np.arange(len(w) + 1))
        z = np.empty((len(h), w.shape[2]), h.dtype)
        for g in range(len(w)):
            np.matmul(h[cut[g] : cut[g + 1]], w[g], out=z[cut[g] : cut[g + 1]])
        z += self.by_group.take(last * len(w) + group, axis=0)
        return _exps(h @ self.p["u"] + self.log_group.take(last, axis=0)), _exps(z), cut

    def log_probs(self, tokens: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
        """log10 P of every token of sequences that lie one after another; `end` stands before each."""
        # before[i + T]: the token before place i; in front of the first place there is nothing
        before = np.full(len(tokens) + T + S, self.v, np.int32)
        before[T + 1 : T + len(tokens)] = tokens[:-1]
        before[T + first[:-1]] = end
        out = np.empty(len(tokens), np.float64)
        at, start = windows(first)
        table, w = self._table(), self._by_group()
        stop = np.minimum(at + S, first[np.searchsorted(first, start, "right")])
        for i in range(0, len(at), BATCH):
            a = at[i : i + BATCH]
            place = a[:, None] + np.arange(S - T, S)
            seen = before[place + T]
            if (early := place[:, :1] < start[i : i + BATCH, None]).any():
                seen[early[:, 0]] = np.where(place[early[:, 0]] >= start[i : i + BATCH][early[:, 0], None], seen[early[:, 0]], self.v)
            h = self._attend(seen, table)
            scored = place[:, T - S :]
            good = (scored < stop[i : i + BATCH, None]).reshape(-1)
            here = np.flatnonzero(good)
            group = self.group_of[tokens[scored.reshape(-1)[here]]]
            order = np.argsort(group, kind="stable")
            here, group = here[order], group[order].astype(np.int64)
            where, x = scored.reshape(-1)[here], seen[:, T - S :].reshape(-1)[here]
            y, every = tokens[where], np.arange(len(here))
            (upper, _, sums), (lower, _, more), _ = self._levels(h.take(here, axis=0), x, group, w)
            out[where] = upper[every, group] + lower[every, self.place[self.own[y]]] - np.log(sums[:, 0] * more[:, 0]) + self.log_pair[x, y]
        return out / np.log(10)

    def train(self, seen: np.ndarray, target: np.ndarray, moments: dict[str, np.ndarray], size: int = 256, rate: float = RATE, seed: int = 1) -> None:
        """One pass of Adam over all windows. seen: (windows, T) tokens before each place; target: (windows, S) classes, -1 where nothing is scored.

        moments: what Adam remembers from one call to the next; empty at first. A token's row changes in the steps that see the token."""
        table, order = self._table(), np.random.default_rng(seed).permutation(len(seen))
        every, at = np.concatenate([self.p[name].ravel() for name in OF_ALL]), 0
        for name in OF_ALL:  # seen through one array, which a step changes
            w = self.p[name]
            self.p[name], at = every[at : at + w.size].reshape(w.shape), at + w.size
        for part in np.array_split(order, -(-len(order) // size)) if len(order) else []:
            rows, by_row, rest = self._parts(seen[part], target[part], table)
            _adam(moments, "table", table[:, LEARNED], rows, by_row, rate)
            _adam(moments, "rest", every[None], np.zeros(1, np.int64), np.concatenate([rest[name].ravel() for name in OF_ALL])[None], rate)
        self.p |= {name: np.ascontiguousarray(table[:, at]) for name, at in (("k", KEY), ("v", VALUE), ("q", QUERY), ("r", ADDED))}

    def _parts(self, seen: np.ndarray, target: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Gradients: the tokens seen, of each its row's, and those of the weights without tokens."""
        kept: dict[str, np.ndarray] = {}
        flat = target.reshape(-1)
        x = self._attend(seen, table, kept)
        # the scored places, in the order of their target's group
        here = np.flatnonzero(flat >= 0)
        here = here[np.argsort(self.group[flat[here]].astype(np.uint8), kind="stable")]
        goal, h, w = flat[here], x.take(here, axis=0), self._by_group()
        group, every, share = self.group[goal], np.arange(len(here)), x.dtype.type(1 / max(1, len(here)))
        (_, upper, sums), (_, lower, more), cut = self._levels(h, seen[:, T - S :].reshape(-1)[here], group, w)
        for dz, total, own in ((upper, sums, group), (lower, more, self.place[goal])):
            dz *= share / total
            dz[every, own] -= share
        dh, dw = upper @ self.p["u"].T, np.empty_like(w)
        for g in range(len(w)):
            part = slice(cut[g], cut[g + 1])
            dh[part] += lower[part] @ w[g].T
            np.matmul(h[part].T, lower[part], out=dw[g])
        a, q, k, v, read = (kept[n] for n in ("a", "q", "k", "v", "read"))
        by_place = np.zeros_like(x)
        by_place[here] = dh
        dh = by_place.reshape(read.shape)
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("nsd,nsd->ns", dh, read)[..., None]
        ds *= a
        near = np.bincount((np.minimum(self.distance, 0) + T - 1).ravel(), np.where(self.distance > 0, 0, ds.sum(axis=0)).ravel(), T).astype(ds.dtype)
        g = np.zeros((*seen.shape, 4 * D), ds.dtype)
        g[..., KEY] = ds.transpose(0, 2, 1) @ q  # q is scaled already
        g[..., VALUE] = a.transpose(0, 2, 1) @ dh
        g[:, T - S :, QUERY] = (ds @ k) * ds.dtype.type(1 / np.sqrt(D))
        g[:, T - S :, ADDED] = dh
        ids = seen.reshape(-1).astype(np.uint16 if self.v < 1 << 16 else np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        # numbers are summed in twos, as complex ones, in less than half the time
        g = g.reshape(len(ids), -1).take(order, axis=0)
        by_row = np.add.reduceat(g.view(np.result_type(g, np.complex64)), begin, axis=0).view(g.dtype)
        return ids[begin].astype(np.int64), by_row, {"u": h.T @ upper, "w": dw[self.group, :, self.place].T, "near": near}

    def _gradients(self, seen: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights, with a row for every token."""
        table = self._table()
        rows, by_row, rest = self._parts(seen, target, table)
        every = np.zeros_like(table[:, LEARNED])
        every[rows] = by_row
        return rest | {"k": every[:, KEY], "v": every[:, VALUE], "q": every[:, QUERY], "r": every[:, ADDED]}


def _adam(moments: dict[str, np.ndarray], name: str, weights: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """A step of Adam on some rows, in place; each row counts its own steps."""
    if name not in moments:
        moments |= {name: np.zeros((2, *weights.shape), np.float32), name + " steps": np.zeros(len(weights), np.int64)}
    (m, v), steps = moments[name], moments[name + " steps"]
    steps[rows] += 1
    mean, square = m.take(rows, axis=0), v.take(rows, axis=0)
    mean += np.float32(0.1) * (g - mean)
    m[rows] = mean
    square += np.float32(0.01) * (g * g - square)
    v[rows] = square
    n = steps[rows][:, None]
    square *= (1 / (1 - 0.99**n)).astype(np.float32)
    np.sqrt(square, out=square)
    square += np.float32(1e-6)
    mean /= square
    mean *= (rate / (1 - 0.9**n)).astype(np.float32)
    weights[rows] -= mean
