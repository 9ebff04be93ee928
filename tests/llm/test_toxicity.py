"""The network's gradients, and held-out quality on invented texts."""

import random
import zlib

import numpy as np

from glossa.llm import toxicity as tox


def test_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) + 0.1 for k, v in tox.fresh_net(rng).items()}
    x = rng.normal(size=(5, 3, tox.WORD_DIM + tox.CHAR_DIM))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    up = np.array([0.3, -1.0, 0.7])
    loss = lambda: float(tox.forward(net, x, mask)[0] @ up)
    _, cache = tox.forward(net, x, mask, keep=True)
    grads, dx = tox.backward(net, x, cache, up)
    for values, grad in [*((net[k], grads[k]) for k in net), (x, dx)]:
        at = tuple(rng.integers(0, n) for n in values.shape)
        kept = values[at]
        values[at] = kept + 1e-2
        more = loss()
        values[at] = kept - 1e-2
        less = loss()
        values[at] = kept
        assert abs((more - less) / 2e-2 - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "lo", "mi", "tek", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 200]))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "foul", "zug" + rng.choice(["ba", "lo", "mi"])])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_quality_and_whole_texts(spark):
    docs, labels = corpus(500)
    long = (1000, "ba lo " * 3000 + "vile foul vile " + "mi " * 2000)
    odd = [(1001, None), (1002, ""), (None, "ba lo"), (1003, "ba lo " * 5000)]
    df = spark.createDataFrame([(*d, 9) for d in [*docs, long, *odd]], "doc_id long, text string, toxic int")
    rows = tox.query(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 505 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i, _ in docs)
    truth = dict(labels)
    pos, neg = [by[i].score for i in held if truth[i]], [by[i].score for i in held if not truth[i]]
    assert np.mean([[p > q for q in neg] for p in pos]) > 0.95
    assert by[1000].score > by[1003].score


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.query(spark.createDataFrame([], "doc_id long, text string"), none).collect() == []
    assert [r.score for r in tox.query(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).collect()] == [0.0]


def test_windows_by_length_score_as_with_masks():
    """The scorer's form of the network against the one that is trained, for windows of every length."""
    rng = np.random.default_rng(5)
    net = tox.fresh_net(rng)
    words = rng.normal(size=(300, tox.WORD_DIM + tox.CHAR_DIM)).astype(np.float32)
    length = np.sort(rng.integers(0, tox.WINDOW + 1, 200))[::-1].copy()
    length[-3:] = 0
    grid = rng.integers(0, 300, (tox.WINDOW, 200))
    mask = (np.arange(tox.WINDOW)[:, None] < length).astype(np.float32)
    known, _ = tox.forward(net, words[grid], mask)
    tables = tuple(tox._halved(words @ net["W" + d] + net["b" + d]) for d in "fb")
    assert np.abs(tox.window_logits(net, tables, grid, length) - known).max() < 1e-4


def test_sample_holds_whole_texts_up_to_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(tox, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(i, "x" * 300) for i in range(1, 30)] + [(30, "y" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 30)) for i in range(1, 31)], "doc_id long, toxic int")
    texts, marks = tox.sampled(docs, labels)
    assert [t for t, y in zip(texts, marks, strict=True) if y] == (["y" * 5000] if zlib.crc32(b"30") % 5 else [])
    assert [len(t) for t, y in zip(texts, marks, strict=True) if not y] == [300] * 3
