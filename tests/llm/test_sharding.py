"""Sharding: places, balance, and growth."""

import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from glossa.llm import sharding


def corpus():
    rng = random.Random(3)
    docs = [(i, rng.choice(["", "é", "word " * rng.randint(1, 400)])) for i in range(600)]
    return [*docs, (5, "twice"), (5, "twice"), (None, None), (None, "x"), (7000, None)]


def test_sizes_places_and_balance(spark):
    docs = corpus()
    rows = sharding.query(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, slot int")).collect()
    want = sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    places, load = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        places[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in rows)


def test_no_rows(spark):
    assert sharding.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_growth_edits_the_map(spark):
    recs = sharding.records(spark.createDataFrame(corpus(), "doc_id long, text string"), 512)
    zero = sharding.initial_map(spark, sharding.slot_loads(recs), 6, 512)
    one = sharding.rebalanced(zero, 6).cache()
    two = sharding.rebalanced(one, 7).cache()
    assert [m.agg(F.max("version")).first()[0] for m in (zero, one, two)] == [0, 1, 2]
    assert one.count() == two.count() == 512
    total = one.agg(F.sum("bytes")).first()[0]
    moved = one.alias("a").join(two.alias("b"), "virtual_slot").where("a.shard <> b.shard").agg(F.sum("a.bytes")).first()[0]
    assert moved < 0.35 * total
    sizes = [r.s for r in two.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
    assert len(sizes) == 7 and max(sizes) < 1.2 * total / 7
