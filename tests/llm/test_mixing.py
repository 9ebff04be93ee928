"""Mixing: apportionment by seats, targets, and what documents give."""

import random
from collections import defaultdict

from glossa.llm import mixing


def by_seats(votes, house):
    seats = dict.fromkeys(votes, 0)
    for _ in range(house):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * seats[p] + 1))
        seats[best] += 1
    return seats


def test_highest_quotients(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(30):
        votes = {p: rng.choice([0, 1, 3, rng.randint(1, 1000)]) for p in range(rng.randint(1, 12))}
        votes[0] = max(1, votes[0])
        house = rng.randint(0, 60)
        want |= {(g, p): n for p, n in by_seats(votes, house).items()}
        rows += [(g, p, v, house) for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g int, p int, votes long, house long")
    got = {(r.g, r.p): r.seats for r in mixing.apportioned(df, ["g"], "p", "votes", "house", "seats").collect()}
    assert got == want


def plain_targets(sizes):
    total, weights = sum(sizes.values()), {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    full, out = set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in sizes} | out
        full |= over


def corpus():
    rng = random.Random(2)
    docs = []
    for i in range(900):
        source = rng.choices([None, "a", "b", "c", "é", "d"], [1, 40, 3, 3, 1, 9])[0]
        docs.append((i, source, rng.choice([None, "", "w " * rng.randint(1, 300)])))
    return [*docs, (3, "a", "same same"), (3, "a", "same same"), (None, "e", "x y z"), (8000, "empty", "")]


def test_mix(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, size int")
    rows = mixing.mixed(df).collect()
    again = mixing.mixed(df.repartition(7)).collect()
    key = lambda rs: sorted(repr((r.doc_id, r.source, r.size, r.taken, r.copies)) for r in rs)
    assert key(rows) == key(again) and len(rows) == len(docs)
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len((t or "").split())
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(40, 0.01 * want[s]) for s in sizes)


def test_no_rows(spark):
    assert mixing.query(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
