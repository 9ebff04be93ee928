"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is an embedding of the word and the mean of the embeddings of its byte strings (five long, word
ends included, and longer beginnings), both in hashed tables; one dimension of each holds class log-odds, of the word and
the highest of its strings. While the network learns, the log-odds of a text come from the other half of the texts, so
that it trusts them no more than it may on new ones. The network reads windows of WINDOW words
that overlap by half; attention weighs the states of both directions. A document's logit is that of its worst window, and training is by the worst
windows too. A last logistic step on documents that training has not seen turns logits into scores.

The network is fitted on a sample of labelled rows, whole texts: at most SAMPLE of each class (those with the smallest hashes of doc_id), and
of these as many as hold SAMPLE_BYTES together; labels of the held-out fold are never read. Scoring reads every word of every
document, in groups of bounded size.

Cases: null and empty texts are a window without words and get a score like any other; null and repeated ids and
repeated rows are scored row by row; without labels of both classes every score is the share of toxic labels (0 if
there are none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import ARROW_ROWS, U, prefix_hash, range_hash

SAMPLE, SAMPLE_BYTES = 2500, 24_000_000
FOLDS = 5
WINDOW, STEP = 64, 32
TABLE = 1 << 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 4, 8, 8, 8
EPOCHS, BATCH, RATE = 5, 128, 0.01
#: Windows scored at once, and words kept with their inputs.
CHUNK, KEPT_WORDS = 1024, 400_000
MARKS = ".,;:!?\"'()[]{}«»…-"


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping ranges that cover n words."""
    return [(a, min(a + WINDOW, n)) for a in range(0, max(1, n - (WINDOW - STEP)), STEP)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """The table rows of some words: of each word, of all their strings one after the other, and how many each has."""

    word: np.ndarray
    flat: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Rows:
        """Hashes of whole words (marks stripped, lower case, ends marked), of their five-byte strings, and of their first 6 to 13 bytes."""
        marked = [b"^%s$" % (w.strip(MARKS).lower() or w).encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        end = np.cumsum(size)
        start = end - size
        data = np.frombuffer(b"".join(marked), np.uint8)
        prefix = prefix_hash(data)
        row = lambda a, b: (range_hash(prefix, a, b) % U(TABLE)).astype(np.int32)
        own, at = np.repeat(np.arange(len(words)), size), np.arange(len(data))
        inside = at + 5 <= end[own]
        short = np.flatnonzero(size < 5)
        owners, found = [own[inside], short], [row(at[inside], at[inside] + 5), row(start[short], end[short])]
        for k in range(6, 14):
            longer = np.flatnonzero(size > k)
            owners.append(longer)
            found.append(row(start[longer], start[longer] + k))
        each = np.unique(np.concatenate(owners) * TABLE + np.concatenate(found))  # once a word, by word
        return Rows(row(start, end), (each % TABLE).astype(np.int32), np.bincount(each // TABLE, minlength=len(words)).astype(np.int64))

    def take(self, at: np.ndarray) -> Rows:
        size = self.size[at]
        first = (np.cumsum(self.size) - self.size)[at]
        flat = self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        return Rows(self.word[at], flat, size)


@dataclass
class Model:
    word: np.ndarray
    char: np.ndarray
    net: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None

    def inputs(self, rows: Rows) -> np.ndarray:
        """The input vectors of some words."""
        if not len(rows.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        first = np.cumsum(rows.size) - rows.size
        chars = np.add.reduceat(self.char[rows.flat], first) / rows.size[:, None]
        chars[:, 0] = np.maximum.reduceat(self.char[rows.flat, 0], first)
        return np.concatenate((self.word[rows.word], chars), axis=1).astype(np.float32)


def _direction(net, d: str, a: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States [T, B, H] of one direction from the projected inputs a [T, B, 3H]; with `keep`, what backward needs."""
    u, steps = net["U" + d], len(a)
    h = np.zeros((a.shape[1], HIDDEN), np.float32)
    out = np.empty((*a.shape[:2], HIDDEN), np.float32)
    saved = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        hu = h @ u
        gates = _sigmoid(a[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(a[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep:
            saved.append((t, r, z, n, hu[:, 2 * HIDDEN :], h, m))
        h = new
        out[t] = h
    return out, saved


def forward(net, x: np.ndarray, mask: np.ndarray, projected: bool = False, keep: bool = False):
    """Logits of windows; x is [T, B, D], or [T, B, 6H] if projected."""
    if not projected:
        x = np.concatenate((x @ net["Wf"] + net["bf"], x @ net["Wb"] + net["bb"]), axis=2)
    f, sf = _direction(net, "f", x[:, :, : 3 * HIDDEN], mask, keep)
    b, sb = _direction(net, "b", x[:, :, 3 * HIDDEN :], mask, keep)
    h = np.concatenate((f, b), axis=2)
    u = np.tanh(h @ net["Wa"] + net["ba"])
    e = np.where(mask > 0, u @ net["va"], -1e9)
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = (a[:, :, None] * h).sum(axis=0)
    logit = pooled @ net["wo"] + net["bo"][0]
    return logit, (h, u, a, pooled, sf, sb) if keep else None


def backward(net, x, cache, dlogit):
    """Gradients of the network and of its inputs."""
    h, u, a, pooled, sf, sb = cache
    g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()])}
    dp = dlogit[:, None] * net["wo"]
    da = (h * dp).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    du = de[:, :, None] * net["va"] * (1 - u**2)
    g["va"] = np.einsum("tb,tbk->k", de, u)
    g["Wa"] = np.einsum("tbh,tbk->hk", h, du)
    g["ba"] = du.sum(axis=(0, 1))
    dh = a[:, :, None] * dp + du @ net["Wa"].T
    dx = np.zeros_like(x)
    for d, saved, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
        w, uu = net["W" + d], net["U" + d]
        gw, gu, gb = np.zeros_like(w), np.zeros_like(uu), np.zeros(3 * HIDDEN)
        carry = np.zeros(part.shape[1:], np.float32)
        for t, r, z, n, hun, before, m in reversed(saved):
            total = part[t] + carry
            dnew = m * total
            dn = dnew * (1 - z) * (1 - n**2)
            dz = dnew * (before - n) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            pre = np.concatenate((dr, dz, dn), axis=1)
            rec = np.concatenate((dr, dz, dn * r), axis=1)
            gw += x[t].T @ pre
            gu += before.T @ rec
            gb += pre.sum(axis=0)
            dx[t] += pre @ w.T
            carry = (1 - m) * total + dnew * z + rec @ uu.T
        g |= {"W" + d: gw, "U" + d: gu, "b" + d: gb}
    return g, dx


def fresh_net(rng) -> dict[str, np.ndarray]:
    dim = WORD_DIM + CHAR_DIM
    make = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    net = {}
    for d in "fb":
        net |= {"W" + d: make(dim, 3 * HIDDEN), "U" + d: make(HIDDEN, 3 * HIDDEN), "b" + d: np.zeros(3 * HIDDEN, np.float32)}
    return net | {"Wa": make(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": make(ATTENTION), "wo": make(2 * HIDDEN), "bo": np.zeros(1, np.float32)}


def log_odds(docs: Iterator[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """By table row: how much likelier it is in a toxic text, drawn towards 0 where it is rare."""
    counts = np.zeros((2, TABLE))
    for rows, y in zip(docs, labels, strict=True):
        counts[int(y), np.unique(rows)] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    seen = counts.sum(axis=0)
    odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
    return np.where(seen >= 3, odds * seen / (seen + 3), 0)


def _dense(words: list[int] | np.ndarray, spans: list[tuple[int, int]], out: np.ndarray, mask: np.ndarray, at: int) -> None:
    for k, (a, b) in enumerate(spans, at):
        out[: b - a, k] = words[a:b]
        mask[: b - a, k] = 1


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """A model from labelled texts; a fifth of them, by place, only sets the scale of scores."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros((1, 1)), np.zeros((1, 1)), constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    docs: list[np.ndarray] = []
    for text in texts:
        own = array("i")
        for w in text.split():
            if (k := names.get(w)) is None:
                k = names[w] = len(names)
            own.append(k)
        docs.append(np.array(own, np.int32))
    rows = Rows.of(list(names))
    del names
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::5]] = True
    learn = np.flatnonzero(~held)
    model = Model(rng.normal(0, 0.1, (TABLE, WORD_DIM)).astype(np.float32), rng.normal(0, 0.1, (TABLE, CHAR_DIM)).astype(np.float32))
    # Copies and edited copies mostly share their longest line, and so their half.
    half = np.array([zlib.crc32(max(t.split("\n"), key=len).encode("utf-8", "surrogatepass")) % 2 for t in texts])
    odds_of = lambda at: (log_odds((rows.word[docs[i]] for i in at), y[at]), log_odds((rows.take(np.unique(docs[i])).flat for i in at), y[at]))
    crossed = [odds_of(learn[half[learn] != k]) for k in (0, 1)]
    final = odds_of(learn)

    def use_odds(odds) -> None:
        model.word[:, 0], model.char[:, 0] = odds

    net = model.net = fresh_net(rng)

    spans = [windows(len(d)) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
    grid, mask = np.zeros((WINDOW, len(owner)), np.int32), np.zeros((WINDOW, len(owner)), np.float32)
    at = 0
    for d, s in zip(docs, spans, strict=True):
        _dense(d, s, grid, mask, at)
        at += len(s)
    first = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))

    def worst(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, owner))
        return order[first]

    def logits(at: np.ndarray) -> np.ndarray:
        """Of the windows `at`, with the log-odds in use."""
        table = model.inputs(rows)
        table = np.concatenate((table @ net["Wf"] + net["bf"], table @ net["Wb"] + net["bb"]), axis=1)
        return np.concatenate([forward(net, table[grid[:, at[a : a + CHUNK]]], mask[:, at[a : a + CHUNK]], projected=True)[0] for a in range(0, len(at), CHUNK)])

    def by_half(value) -> np.ndarray:
        """Values of all windows, each half's under the other half's log-odds."""
        out = np.zeros(len(owner))
        for k in (0, 1):
            at = np.flatnonzero(half[owner] == k)
            if len(at):
                use_odds(crossed[k])
                out[at] = value(at)
        return out

    def strongest(at: np.ndarray) -> np.ndarray:
        odds = model.word[rows.word, 0] + model.inputs(rows)[:, WORD_DIM] if len(rows.word) else np.zeros(1)
        return (np.maximum(odds[grid[:, at]], 0) * mask[:, at]).max(axis=0)

    pick = worst(by_half(strongest))
    memory = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    sums = {"word": np.full(TABLE, 1e-3, np.float32), "char": np.full(TABLE, 1e-3, np.float32)}
    weight = np.where(y == 1, (y[learn] == 0).sum() / max(1, (y[learn] == 1).sum()), 1.0) ** 0.5
    step = 0
    for epoch in range(EPOCHS):
        if epoch > 1:
            pick = worst(by_half(logits))
        order = rng.permutation(learn)
        parts_of = [order[half[order] == k] for k in (0, 1)]
        turns = [(k, own[a : a + BATCH]) for k, own in enumerate(parts_of) for a in range(0, len(own), BATCH)]
        for turn in rng.permutation(len(turns)):
            k, own = turns[turn]
            use_odds(crossed[k])
            g, m = grid[:, pick[own]], mask[:, pick[own]]
            used, back = np.unique(g, return_inverse=True)
            parts = rows.take(used) if len(rows.word) else None
            table = model.inputs(parts) if parts else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
            x = table[back.reshape(g.shape)]
            logit, cache = forward(net, x, m, keep=True)
            dlogit = ((_sigmoid(logit) - y[own]) * weight[own] / len(own)).astype(np.float32)
            grads, dx = backward(net, x, cache, dlogit)
            step += 1
            for k, v in grads.items():
                one, two = memory[k]
                one += 0.1 * (v - one)
                two += 0.001 * (v**2 - two)
                net[k] -= RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-7)
            if parts:
                dtable = np.zeros_like(table)
                np.add.at(dtable, back.ravel(), (dx * m[:, :, None]).reshape(-1, dx.shape[2]))
                grams = np.repeat(dtable[:, WORD_DIM:] / parts.size[:, None], parts.size, axis=0)
                for name, at_, grad in (("word", parts.word, dtable[:, :WORD_DIM]), ("char", parts.flat, grams)):
                    touched, of = np.unique(at_, return_inverse=True)
                    total = np.zeros((len(touched), grad.shape[1]), np.float32)
                    np.add.at(total, of, grad)
                    total[:, 0] = 0  # the log-odds are not learnt
                    sums[name][touched] += (total**2).mean(axis=1)
                    getattr(model, name)[touched] -= 0.02 * total / np.sqrt(sums[name][touched])[:, None]
    use_odds(final)
    value = np.maximum.reduceat(logits(np.arange(len(owner))), first)
    use = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    model.scale = calibrated(value[use], np.log1p(np.bincount(owner, minlength=len(y)))[use], y[use])
    return model


def calibrated(logit: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the logit, the log of the number of windows, and 1, by logistic regression with a mild pull to the raw logit."""
    x = np.stack((logit, size, np.ones(len(y))), axis=1).astype(float)
    w, prior = np.array([1.0, 0.0, 0.0]), np.array([1.0, 0.0, 0.0])
    pull = np.diag([0.5, 2.0, 0.01])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + pull @ (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull + 1e-6 * np.eye(3)
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(w[0], 0.05)), float(w[1]), float(w[2])


def _halved(x: np.ndarray) -> np.ndarray:
    """Gate inputs by half, since a logistic function is a hyperbolic tangent of half its input."""
    x = np.array(x, np.float32)
    x[..., : 2 * HIDDEN] *= 0.5
    return x


def window_logits(net, tables: tuple[np.ndarray, np.ndarray], grid: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As `forward`, without masks: logits of windows by length, longest first; `tables` hold the halved projections of words for each direction."""
    steps = max(1, int(length[0]))
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # windows that reach a step
    states = np.zeros((steps, len(length), 2 * HIDDEN), np.float32)
    for d, table, order in (("f", tables[0], range(steps)), ("b", tables[1], range(steps - 1, -1, -1))):
        u, at = _halved(net["U" + d]), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
        h = np.zeros((len(length), HIDDEN), np.float32)
        for t in order:
            own = h[: live[t]]
            a, hu = table.take(grid[t, : live[t]], axis=0), own @ u
            gates = a[:, : 2 * HIDDEN]
            gates += hu[:, : 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = gates[:, :HIDDEN] * hu[:, 2 * HIDDEN :]
            new += a[:, 2 * HIDDEN :]
            np.tanh(new, out=new)
            own -= new
            own *= gates[:, HIDDEN:]
            own += new
            states[t, : live[t], at] = own
    e = np.tanh(states @ net["Wa"] + net["ba"]) @ net["va"]
    e[np.arange(steps)[:, None] >= np.maximum(length, 1)] = -1e9
    e = np.exp(e - e.max(axis=0))
    pooled = np.einsum("tb,tbh->bh", e / e.sum(axis=0), states)
    return pooled @ net["wo"] + net["bo"][0]


class Scorer:
    """Scores texts with a model; keeps the projected inputs of words it has met."""

    def __init__(self, model: Model):
        self.model, self.names = model, {}
        self.tables = tuple(np.zeros((1, 3 * HIDDEN), np.float32) for _ in "fb")

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        out = np.full(len(texts), -np.inf)
        count = np.zeros(len(texts))
        held: list[tuple[int, list[str], list[tuple[int, int]]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = text.split()
            spans = windows(len(words))
            count[i] = len(spans)
            for a in range(0, len(spans), CHUNK):
                part = spans[a : a + CHUNK]
                lo, hi = part[0][0], part[-1][1]
                held.append((i, words[lo:hi], [(p - lo, q - lo) for p, q in part]))
                size += len(part)
                if size >= CHUNK:
                    self._run(held, out)
                    held, size = [], 0
        if held:
            self._run(held, out)
        a, b, c = self.model.scale
        return _sigmoid(a * out + b * np.log1p(count) + c)

    def _known(self, words: list[str]) -> np.ndarray:
        """Places of the words in the tables."""
        names, new = self.names, []
        own = list(map(names.get, words))
        if None in own:
            for w in words:
                if w not in names:
                    names[w] = len(names)
                    new.append(w)
            own = list(map(names.get, words))
        if new:
            x, net, first = self.model.inputs(Rows.of(new)), self.model.net, len(names) - len(new)
            if len(names) > len(self.tables[0]):
                self.tables = tuple(np.concatenate((t[:first], np.empty((2 * len(names) - first, 3 * HIDDEN), np.float32))) for t in self.tables)
            for t, d in zip(self.tables, "fb", strict=True):
                t[first : len(names)] = _halved(x @ net["W" + d] + net["b" + d])
        return np.array(own, np.int32)

    def _run(self, held, out: np.ndarray) -> None:
        if len(self.names) > KEPT_WORDS:
            self.names = {}
        words = self._known([w for _, own, _ in held for w in own])
        base = np.cumsum([0, *(len(own) for _, own, _ in held)])[:-1].tolist()
        start = np.array([b + p for b, (_, _, spans) in zip(base, held, strict=True) for p, _ in spans], np.int64)
        length = np.array([q - p for _, _, spans in held for p, q in spans], np.int64)
        owner = np.repeat([i for i, _, _ in held], [len(spans) for _, _, spans in held])
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        words = np.concatenate((words, np.zeros(WINDOW, np.int32)))
        for a in range(0, len(start), CHUNK):
            part = slice(a, a + CHUNK)
            grid = words[np.arange(max(1, int(length[a])))[:, None] + start[part]]
            np.maximum.at(out, owner[part], window_logits(self.model.net, self.tables, grid, length[part]))


_scorers: list[Scorer] = []


def kept_scorer(model: Model) -> Scorer:
    """The scorer of a model; a worker process keeps the last one, with its words, for its next task."""
    if not _scorers or _scorers[0].model is not model:
        _scorers[:] = [Scorer(model)]
    return _scorers[0]


def held_out() -> F.Column:
    """Whether a row's labels are kept for testing: CRC-32 of the id, as text, leaves no remainder by FOLDS."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Whole texts and labels for `fit`, from rows that are not held out: by hash of the id, up to `most` of each class and SAMPLE_BYTES (the first in any case)."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for c in (0, 1):
        part = marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id").alias("draw"), F.xxhash64("text").alias("again")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy("draw", "doc_id", "again").limit(2 * most)
    before = Window.partitionBy("toxic").orderBy("draw", "doc_id", "again").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.select("doc_id", "draw", "again", "toxic", F.octet_length("text").cast("long").alias("size"))
    fits = sizes.withColumn("upto", F.col("size") + F.sum("size").over(before)).where(F.coalesce(F.col("upto") <= SAMPLE_BYTES, F.lit(True)))
    fits = F.broadcast(fits.select("doc_id", "again").distinct())
    found = sorted((r["toxic"], r["doc_id"], r["text"]) for r in rows.join(fits, ["doc_id", "again"]).select("toxic", "doc_id", "text").collect())
    return [t for _, _, t in found], [y for y, _, _ in found]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_scorer(shared.value)
        for batch in batches:
            value = scorer.scores([x or "" for x in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(*sampled(docs, labels))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
