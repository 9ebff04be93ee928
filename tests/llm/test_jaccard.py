"""The join of shingle sets against exact similarities of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from glossa.llm import jaccard


def brute(docs, n=3, threshold=90):
    sets = {}
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = low.encode().split()
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    find = lambda x: x if group[x] == x else find(group[x])
    for x, y in combinations(sorted(sets), 2):
        k = len(sets[x] & sets[y])
        if k and 100 * k >= threshold * len(sets[x] | sets[y]):
            a, b = sorted((find(x), find(y)))
            group[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def same(spark, docs, **more):
    rows = jaccard.joined(spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, tree string, size int"), **more).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, **more)
    assert len(rows) == len(docs)


def corpus(seed, size=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéF") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(k)] for k in (3, 7, 11, 12, 20, 60, 61, 150, 400)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  Two\n"), (7, "word " * 30_000)]
    for i in range(8, size):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [word()][: rng.choice([0, 1, 1, 1])]
        docs.append((i, rng.choice([" ", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize(("n", "threshold"), [(3, 90), (2, 75)])
def test_against_all_pairs(spark, n, threshold):
    same(spark, corpus(n), n=n, threshold=threshold)


def test_copies_that_only_link_through_the_text_they_come_from(spark):
    """Two copies of a text with an edit each are too far apart; the text itself has neither the least id nor any mark."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(3, 97)] = f"e{i}"
        docs.append((i if i < 45 else i + 1, " ".join(words)))
    docs.append((45, " ".join(base)))
    same(spark, docs)
    assert {c for _, c in brute(docs).values()} == {0}


def test_pairs_of_a_large_tree_without_a_middle(spark, monkeypatch):
    """Many sets that meet in trees but do not link, among them some pairs that do; leaves and tiles are small, so all levels are gone through."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FANOUT", 3)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    edit = lambda words, k: [f"{rng.random()}" if i in at else w for at in [set(rng.sample(range(len(words)), k))] for i, w in enumerate(words)]
    docs = []
    for i in range(70):
        own = edit(base, 4)
        docs += [own, edit(own, 1)] if i % 5 == 0 else [own]
    same(spark, [(i, " ".join(w)) for i, w in enumerate(docs)])


def test_tree_pairs_against_all_points(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "FANOUT", 2)
    rng = np.random.default_rng(1)
    points = [rng.poisson(m, jaccard.GROUPS).astype(np.int32) for m in rng.choice([0.3, 1, 6], 40)]
    points += [p + (rng.random(jaccard.GROUPS) < 0.02).astype(np.int32) for p in points for _ in range(3)]
    label = lambda i: i % 7
    rows = [(t, i, label(i), int(p.sum()), bytes(p.tobytes())) for t in (1, 2) for i, p in enumerate(points) if (i + t) % 3]
    reps = spark.createDataFrame([(i, int(p.sum()), bytes(p.tobytes())) for i, p in enumerate(points)], "node long, n_shingles long, point binary")
    open_ = spark.createDataFrame([r[:3] for r in rows], "tree long, node long, label long").repartition(3)
    got = {tuple(sorted(r)) for r in jaccard.tree_pairs(jaccard.placed(open_, reps), 90).collect()}
    want = set()
    for t in (1, 2):
        for (_, i, a, n, p), (_, j, b, m, q) in combinations([r for r in rows if r[0] == t], 2):
            if a != b and 190 * int(np.minimum(np.frombuffer(p, np.int32), np.frombuffer(q, np.int32)).sum()) >= 90 * (n + m):
                want.add((i, j))
    assert got == want and want


def test_near_texts_below_the_threshold_are_not_listed_in_each_tree(spark, monkeypatch):
    """Texts that differ in some 12 percent of their shingles meet in many trees, but their bits tell all of them apart there."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(600)]
    docs = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(0, 600, 4), 13):
            words[at] = f"e{i}-{at}"
        docs.append((i, " ".join(words)))
    listed = []
    plain = jaccard.tree_pairs
    monkeypatch.setattr(jaccard, "tree_pairs", lambda rows, threshold: listed.append((plain(rows, threshold).count(), rows.count())) or plain(rows, threshold))
    same(spark, docs)
    assert len({c for _, c in brute(docs).values()}) == 60
    assert listed[0][0] <= 60 < listed[0][1]


def test_bits_never_drop_a_link():
    """Sets at the threshold have few bits that differ, whatever their size."""
    rng = np.random.default_rng(5)
    for size in [10, 19, 100, 1000, 20_000]:
        most = jaccard.differing(size, size, 90)
        a = rng.integers(1, 2**63, size, dtype=np.uint64)
        b = np.concatenate((a[most // 2 :], rng.integers(1, 2**63, most // 2, dtype=np.uint64)))
        bits = [np.packbits((np.bincount((jaccard.mix(x) % np.uint64(jaccard.PARITY)).astype(np.int64), minlength=jaccard.PARITY) & 1).astype(np.uint8)).view(np.uint64)[None] for x in (a, b)]
        assert jaccard._like(*bits, np.array([2 * size]), 90).all()


def test_linked_sets_share_a_tree():
    """Sets at the threshold, of all sizes, always have a group with equal content."""
    rng = np.random.default_rng(2)
    for size in [9, 10, 14, 15, 21, 22, 40, 99, 100, 500, 3000]:
        for _ in range(20):
            most = jaccard.differing(size, size, 90)
            less = int(rng.integers(0, most + 1))
            a = rng.integers(1, 2**63, size, dtype=np.uint64)
            b = a[less:]
            while (100 * len(b)) < 90 * size:
                less -= 1
                b = a[less:]
            key, doc = np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)])
            trees, count = jaccard.tree_keys(key, doc, np.array([len(a), len(b)]), 90)
            shared = np.intersect1d(trees[: count[0]], trees[count[0] :])
            assert len(shared) or size == len(b)


def test_size_classes_cover_partners():
    classes = jaccard.size_classes(5000, 90)
    assert classes[0][0] == 10 and all(a[1] == b[0] for a, b in zip(classes, classes[1:]))
    for big in (10, 11, 14, 15, 100, 4999):
        low, end, parts = next(c for c in classes if c[0] <= big < c[1])
        for small in range(-(-90 * big // 100), big + 1):
            assert 100 * small >= 90 * low and small < end and parts > jaccard.differing(small, big, 90)


def test_null_ids_equal_rows_one_id_and_no_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(None, a), (2, a), (2, a), (1, a), (1, b), (5, b + " c"), (None, None)], "doc_id long, text string")
    rows = jaccard.query(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in rows) == [(0, 0, 0), (0, 0, 58), (1, 1, 58), (1, 1, 58), (2, 1, 58), (2, 1, 58), (5, 1, 59)]
    assert jaccard.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
