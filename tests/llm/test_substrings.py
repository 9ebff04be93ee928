"""Removal of repeated substrings against a direct reading of the rule."""

import hashlib
import random

from glossa.llm import substrings


def brute(docs, length=100):
    """docs: (doc_id, text) with distinct ids -> {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    seen, out = {}, {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[w] = True
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 350), (5, "ab" * 300), (6, "ab" * 120 + "c" * 120 + "ab" * 80)]
    for i in range(7, 120):
        bits = [" ".join(word() for _ in range(rng.randint(0, 60))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["", " ", "\n"]).join(bits)
        if rng.random() < 0.2:
            text = docs[rng.randrange(7, i)][1] if i > 8 else text
        if rng.random() < 0.2 and len(text) > 50:
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        docs.append((i, text))
    return docs


def test_against_brute_force(spark):
    docs = corpus(1)
    rows = substrings.query(spark.createDataFrame(random.Random(2).sample(docs, len(docs)), "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == brute(docs)


def test_texts_in_parts(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(substrings, "PART", 130)
    found = {}
    for doc, _, base, data in substrings.parts(*_arrays(docs)):
        found.setdefault(doc, []).append((base, data))
    for doc, text in docs:
        data = (text or "").encode()
        windows = {(base + p) for base, part in found[doc] for p in range(len(part) - 99)}
        assert windows == set(range(len(data) - 99))
        assert all(data[b : b + len(part)] == part for b, part in found[doc])


def _arrays(docs):
    import numpy as np

    return np.array([d[0] for d in docs]), np.zeros(len(docs), np.uint32), [(d[1] or "").encode() for d in docs]


def test_shared_ids_nulls_and_no_rows(spark):
    a, b = "p" * 60 + "q" * 60, "r" * 70 + "s" * 70
    rows = substrings.query(spark.createDataFrame([(None, a), (1, a), (1, a), (1, b), (2, b), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None and r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(False, 120, 0), (1, 120, 120), (1, 120, 120), (1, 140, 0), (2, 0, 0), (2, 140, 140)]
    assert substrings.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
