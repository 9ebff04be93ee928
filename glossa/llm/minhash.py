"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, and only one representative goes on. Band keys of the signatures put representatives
into buckets. A pair of a bucket is first judged on its signatures, batch by batch: with m of k hashes equal and a
flat prior, the chance that the similarity reaches the threshold is a binomial tail, and the pair goes where that
chance falls below the chosen miss probability. Survivors are confirmed on the full sets of both texts.

A bucket need not list all its pairs, since only the groups matter: first everyone is compared with the bucket's
smallest member, then, where groups still meet in a bucket, with a member drawn by the bucket's key. What is left are members
whose groups are different and who may still be linked. Their shingles are counted over all of them: one that a single group
holds is in no intersection that matters; one that at most RARE members hold is rare. A pair at the threshold either shares a
rare shingle, and is found in an inverted index of those, no list of which has more than RARE members, or it shares enough frequent ones
alone, so that both members have enough of them: such heavy members meet in their buckets, where only those outside the bucket's largest group
are compared with the others, each pair once. Two exact bounds, on sizes and on bit maps of the sets, rule out most of
these pairs inside the join, and no link is left out. Groups come from repeated minimum labels with pointer jumping. Every step writes its table to the shared
folder; no links, groups or fingerprints reach the driver.

Cases: null texts and texts without words have an empty set and are linked with nothing, as are rows with a null id;
such rows keep themselves (with a null id `component_id` is null and `kept` true). Rows that share an id are
one document and linked. Repeated rows form a class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written, written_at
from .vector import ARROW_ROWS, U, Words, groups, mix, powers

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
THRESHOLD = 80
MISS = 1e-5
#: A shingle that more members of the last round hold is frequent.
RARE = 8
#: Longs of a set's bit map: a bit of one that the other lacks stands for a shingle, at least, that it lacks.
MAP_LONGS = 16

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OTHER = 0xC2B2AE3D27D4EB4F


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in order (with repeats), and how many each text has."""
    words = Words(texts, fold=True)
    key, at = words.windows(n)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        h = words.hashes()
        steps = powers(_OTHER, n + 1)
        extra = np.array([mix((h[a : a + c] * steps[1 : c + 1]).sum(dtype=U)[None] + U(c))[0] for a, c in zip(words.first[short], words.count[short], strict=True)], U)
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        key, doc = np.concatenate((key, extra))[order], doc[order]
    return key, np.bincount(doc, minlength=len(texts))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sig): the set's size, a 128-bit fingerprint of it, and its minimum hashes (null for an empty set)."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("_text").to_pylist()]
            size, f1, f2, sig = [], [], [], []
            for a, b in groups(texts):
                key, count = shingles(texts[a:b], n)
                first = np.concatenate(([0], np.cumsum(count)))
                some = np.flatnonzero(count)
                sigs = np.empty((len(some), HASHES), np.uint32)
                if len(some):
                    low = (key >> U(32)).astype(np.uint32)
                    for k in range(HASHES):
                        sigs[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], first[some])
                at = dict(zip(some.tolist(), range(len(some)), strict=True))
                for i in range(b - a):
                    own = np.unique(key[first[i] : first[i + 1]])
                    size.append(len(own))
                    f1.append(own.sum(dtype=U).astype(np.int64).item())
                    f2.append(mix(own ^ U(_OTHER)).sum(dtype=U).astype(np.int64).item())
                    sig.append(sigs[at[i]].tobytes() if i in at else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_rows(reps: DataFrame) -> DataFrame:
    """(band, node): a key for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(U)
            key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), parts.shape[:2]).copy()
            for r in range(ROWS):
                key = mix(key * U(_OTHER) + parts[:, :, r])
            node = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), batch.column("node").take(pa.array(node))], names=["band", "node"])

    rows = reps.select("node", "sig")
    return rows.mapInArrow(run, f"band long, node {rows.schema['node'].dataType.simpleString()}")


def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> list[int]:
    """For each number of batches compared: matches below which the similarity reaches the threshold with less chance than `miss`."""
    t, out = threshold / 100, []
    for k in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while m < k:
            m += 1
            tail += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return out


def plausible(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) that sizes and signature batches do not rule out."""
    left = reps.select(F.col("node").alias("x"), F.col("n_shingles").alias("nx"), F.col("sig").alias("sx"))
    right = reps.select(F.col("node").alias("y"), F.col("n_shingles").alias("ny"), F.col("sig").alias("sy"))
    both = pairs.join(left, "x").join(right, "y")
    both = both.where(100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny")).select("x", "y", "sx", "sy")
    bounds = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("sx")), _matrix(batch.column("sy"))
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for k, bound in enumerate(bounds):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
                alive, matches = alive[matches >= bound], matches[matches >= bound]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("x", "y")], names=["x", "y"])

    return both.mapInArrow(run, pairs.select("x", "y").schema)


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    left = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    both = pairs.join(left, "x").join(right, "y").select("x", "y", "tx", "ty")

    def sets(column: pa.Array) -> list[np.ndarray]:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]
        out: list[np.ndarray] = []
        for a, b in groups(raw):
            key, count = shingles(raw[a:b], n)
            end = np.cumsum(count)
            out += [np.unique(key[e - c : e]) for e, c in zip(end.tolist(), count.tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yes = []
                for p, q in zip(sets(part.column("tx")), sets(part.column("ty")), strict=True):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    yes.append(shared > 0 and 100 * shared >= threshold * (len(p) + len(q) - shared))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(yes, pa.bool_())) for c in ("x", "y")], names=["x", "y"])

    return both.mapInArrow(run, pairs.select("x", "y").schema)


def open_shingles(open_: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(node, label, shingle, map) of the nodes (node, label); `map`, the set's bit map, stands in the first row of a node."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            for a, b in groups(raw):
                key, count = shingles(raw[a:b], n)
                end = np.cumsum(count)
                own = [np.unique(key[e - c : e]) for e, c in zip(end.tolist(), count.tolist(), strict=True)]
                row = np.repeat(np.arange(a, b), [len(x) for x in own])
                maps: list[list[int] | None] = []
                for x in own:
                    bits = np.zeros(MAP_LONGS * 64, np.uint8)
                    bits[(mix(x) % U(MAP_LONGS * 64)).astype(np.int64)] = 1
                    maps += [np.packbits(bits).view(np.int64).tolist(), *[None] * (len(x) - 1)] if len(x) else []
                cols = [batch.column(c).take(pa.array(row)) for c in ("node", "label")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(own).astype(np.int64)), pa.array(maps, pa.list_(pa.int64()))], names=["node", "label", "shingle", "map"])

    return texts.join(open_, "node").select("node", "label", "text").mapInArrow(run, f"node {kind}, label {kind}, shingle long, map array<long>")


def last_pairs(at: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """(x, y): every pair of nodes of different labels that can reach the threshold, by a shared rare shingle or, within a bucket of `at` (band, node, label), by frequent ones."""
    rows = written(open_shingles(at.select("node", "label").distinct(), texts, n), "open-shingles")
    several = rows.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("held")).where("a <> b")
    several = written(several.select("shingle", "held"), "shared-shingles")
    several_texts = F.count("map") > 1  # of rows that share an id: the bounds below then say less, not more
    facts = rows.join(several, "shingle", "left").groupBy("node").agg(
        F.when(several_texts, 0).otherwise(F.count(F.lit(1))).alias("n"), F.count("held").alias("shared"),
        F.count_if(F.col("held") > RARE).alias("frequent"), F.when(~several_texts, F.max("map")).alias("map"),
    )
    facts = written(facts.where(100 * F.col("shared") >= threshold * F.col("n")), "open-sets")
    enough = lambda k: 100 * k >= threshold * (F.col("n") + F.col("n_y") - k)
    size = facts.select("node", "n", "frequent")

    lists = several.where(F.col("held") <= RARE).select("shingle")
    rare = written(rows.select("node", "label", "shingle").join(lists, "shingle").join(size, "node"), "rare-shingles")
    other = rare.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("node", "label", "n", "frequent")])
    met = rare.join(other, "shingle").where((F.col("node") < F.col("node_y")) & (F.col("label") != F.col("label_y")))
    met = met.groupBy("node", "node_y").agg(F.count(F.lit(1)).alias("rare"), *[F.first(c).alias(c) for c in ("n", "n_y", "frequent", "frequent_y")])
    by_rare = met.where(enough(F.col("rare") + F.least("frequent", "frequent_y"))).select(F.col("node").alias("x"), F.col("node_y").alias("y"))

    heavy = facts.where(100 * F.col("frequent") >= threshold * F.col("n")).select("node", "n", "frequent", "map")
    heavy = written(at.join(heavy, "node"), "heavy")
    most = heavy.groupBy("band", "label").agg(F.count(F.lit(1)).alias("members"))
    most = most.groupBy("band").agg(F.max_by("label", F.struct("members", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("band", "largest")
    heavy = written(heavy.join(most, "band"), "heavy-open")
    bands = heavy.groupBy("node").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # a node has BANDS at most
    heavy = heavy.join(bands, "node")
    smaller = heavy.where("label <> largest")
    other = heavy.select(*[F.col(c).alias(f"{c}_y") for c in ("band", "node", "label", "n", "frequent", "map", "bands")])
    lacks = lambda p, q: sum((F.bit_count(F.col(p)[k].bitwiseAND(F.bitwise_not(F.col(q)[k]))) for k in range(MAP_LONGS)), F.lit(0))
    once = F.array_min(F.array_intersect("bands", "bands_y")) == F.col("band")
    # Two members outside the largest group meet in both orders; one of them counts.
    turn = (F.col("label_y") == F.col("largest")) | (F.col("node") < F.col("node_y"))
    able = (F.col("label") != F.col("label_y")) & turn & enough(F.least("frequent", "frequent_y"))
    maps = enough(F.col("n") - lacks("map", "map_y")) & enough(F.col("n_y") - lacks("map_y", "map"))
    able = able & F.coalesce(maps, F.lit(True)) & once
    by_band = smaller.join(other, (F.col("band") == F.col("band_y")) & able)
    return by_rare.union(by_band.select(F.least("node", "node_y").alias("x"), F.greatest("node", "node_y").alias("y")))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links (x, y) lead to, for every node with a link."""
    spark = links.sparkSession
    edges, edges_at = written_at(links.select("x", "y").union(links.select("y", "x")).distinct(), "edges")
    state, state_at = written_at(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        told = edges.join(state.select(F.col("node").alias("x"), "label"), "x").groupBy(F.col("y").alias("node")).agg(F.min("label").alias("told"))
        least = state.join(told, "node").select("node", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        jump = state.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        after = least.join(jump, least["label"] == jump["_at"], "left").select("node", "was", F.least("label", F.coalesce("_to", "label")).alias("label"))
        after, after_at = written_at(after, "labels")
        done = after.where(F.col("label") != F.col("was")).isEmpty()
        dropped(spark, state_at)
        state, state_at = after.drop("was"), after_at
        if done:
            dropped(spark, edges_at)
            return state


def grouped(docs: DataFrame, n: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; shingles of n words, similarity of `threshold` percent."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, n), "signatures")
    live = sigs.where(F.col("sig").isNotNull() & F.col("doc_id").isNotNull())
    classes = live.groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "sig")).alias("rep"))
    reps = written(classes.select("n_shingles", "f1", "f2", F.col("rep.doc_id").alias("node"), F.col("rep.sig").alias("sig")), "representatives")

    bands, bands_at = written_at(band_rows(reps), "bands")
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    members = written(bands.join(shared.select("band", "least"), "band"), "members")
    dropped(spark, bands_at)
    needed = members.select("node").distinct()
    whole = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).where(F.col("node").isNotNull())
    texts = written(whole.join(needed, "node", "left_semi"), "candidate-texts")

    first = members.where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y")).distinct()
    links = written(confirmed(plausible(first, reps, threshold), texts, n, threshold), "links")
    tested = written(first, "tested")
    for last in (False, True):
        labels = components(links)
        at = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("band", "node", "label")
        open_ = at.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min_by("node", F.xxhash64("node", "band")).alias("pivot")).where("a <> b")
        at = written(at.join(open_.select("band", "pivot"), "band"), "open")
        if last:
            pairs = last_pairs(at.select("band", "node", "label"), texts, n, threshold)
        else:
            pivots = at.where("node = pivot").select("band", F.col("node").alias("y"), F.col("label").alias("other")).distinct()
            pairs = at.withColumnRenamed("node", "x").join(pivots, "band").where("label <> other")
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(tested, ["x", "y"], "left_anti")
        pairs = written(pairs, "tested")
        found = written(confirmed(plausible(pairs, reps, threshold), texts, n, threshold), "links")
        links, tested = links.union(found), tested.union(pairs)
    labels = components(links)

    of_class = reps.select("n_shingles", "f1", "f2", "node").join(labels, "node", "left")
    of_class = of_class.select("n_shingles", "f1", "f2", F.coalesce("label", "node").alias("component_id"))
    linked = live.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where(F.col("sig").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(docs: DataFrame) -> DataFrame:
    return grouped(docs, n=4)
