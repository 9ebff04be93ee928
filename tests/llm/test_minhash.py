"""Near-duplicate groups against exact similarities of all pairs."""

import random

import pytest

from glossa.llm import minhash


def brute(docs, n):
    sets = {}
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = low.encode().split()
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    find = lambda x: x if group[x] == x else find(group[x])
    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            k = len(sets[x] & sets[y])
            if k and 100 * k >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                group[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def corpus(seed, size=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéF") for _ in range(rng.randint(1, 5)))
    bases = [[word() for _ in range(rng.choice([3, 6, 20, 60, 150]))] for _ in range(8)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  Two\n")]
    for i in range(7, size):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = word()
        docs.append((i, rng.choice([" ", "\n"]).join(words)))
    return docs


@pytest.mark.parametrize("n", [4, 5])
def test_against_all_pairs(spark, n):
    docs = corpus(n)
    rows = minhash.grouped(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node int"), n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs, n)


def test_pairs_that_few_rare_shingles_decide(spark):
    """Of 2500 shingles a pair shares 2220 that all texts have and few of its rare ones; others share the rest, so no count of one text tells."""
    run = lambda name, size: [f"{name}{i}" for i in range(size + 4)]
    docs, pairs = [], range(100, 180, 2)
    for k, x in enumerate(pairs):
        base, few, left, right = run("b", 2220), run(f"s{k}_", 3), run(f"l{k}_", 269), run(f"r{k}_", 269)
        docs += [(k, base + left + right + run(f"z{k}_", 750)), (x, base + few + left), (x + 1, base + few + right)]
    assert brute([(i, " ".join(w)) for i, w in docs[:6]], 5)[101][1] == 100
    rows = minhash.grouped(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.component_id != r.doc_id} == {x + 1 for x in pairs}
    assert all(r.component_id == r.doc_id - 1 for r in rows if r.component_id != r.doc_id)


def test_edited_copies_of_a_text_that_is_not_there(spark):
    """Members of one bucket that mostly do not link, of which some pairs share their edits, so that no pivot shows them."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    edit = lambda words, k: [rng.choice(["q", "r", "s"]) + str(rng.random()) if i in at else w for at in [set(rng.sample(range(len(words)), k))] for i, w in enumerate(words)]
    docs = []
    for i in range(60):
        own = edit(base, 11)
        docs += [own, edit(own, 4)] if i % 4 == 0 else [own]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(1000, "lone " + " ".join(base[:200]))]
    rows = minhash.grouped(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute(docs, 5)


def test_two_texts_of_one_id(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:58])), (3, " ".join(b[:58])), (4, " ".join(a[:30] + b[:30]))]
    rows = minhash.grouped(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_null_ids_equal_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = minhash.query(spark.createDataFrame([(None, text), (2, text), (2, text), (1, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert minhash.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bounds_keep_true_pairs():
    bounds = minhash.least_matches()
    assert bounds == sorted(bounds) and all(0 < b <= 0.8 * minhash.BATCH * (k + 1) for k, b in enumerate(bounds))
