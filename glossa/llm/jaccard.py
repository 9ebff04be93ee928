"""Exact Jaccard join of shingle sets through R-trees over count vectors.

Shingles are hashed into GROUPS groups, and the counts of a set's shingles by group are a point. Two sets share at most the sum of
their coordinates' minima, so an R-tree over the points, whose boxes hold the greatest and least counts below them, bounds what any two members of two
boxes can share: sum(min(hi, hi')). Pairs of boxes, then of points, that cannot reach the threshold go; the rest is confirmed on full sets.

One tree over all points does not scale: for sets of more than some hundred shingles a box of unrelated points bounds nothing, and all pairs of equal
sizes would be looked at. So points are first dealt to many trees, in which linked sets must meet. Two sets of sizes a and b that reach t percent differ in
at most R = (a + b)(100 - t)/(100 + t) shingles. Over R + 1 groups, at least one group then holds exactly the same shingles of both. Sizes form classes; a class
fixes R and so the groups, and a set is dealt to the tree of every (class, group, content) that it has, in its own class and in the next where larger partners may lie.

Sets that are equal form one node. First every node meets the smallest of its tree, then, in trees where different components still
meet, the tree's most central member, the one with the most fellows over all its trees; so large groups of near copies become one component without their pairs. Only what is still
apart is packed into R-trees: points in order of tree, size and interleaved coordinates are cut into leaves and tiles, tiles of a tree meet by a join on box bounds, and a task goes
through two tiles' leaves and points. Boxes of one component are passed over. No link is left out, and no links, points or components reach the driver.

Summed minima are loose for sets that nearly link: shingles that differ but fall into one group count as shared. Each set thus has PARITY bits too, each telling whether an odd number of its
shingles falls there. Two sets differ in at least as many shingles as bits, so pairs of a tree whose bits tell them apart go where they are met, and groups of texts that are
near but below the threshold, which meet in most of their trees, are not listed pair by pair in each of them.

Cases: null texts and texts without words have an empty set and are linked with nothing, as are rows with a null id (`component_id` null). Rows that share an id are
one document and linked. Repeated rows are one node; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written, written_at
from .minhash import components, confirmed, shingles
from .vector import U, groups, mix

SHINGLE, THRESHOLD = 3, 90
#: Coordinates of a point.
GROUPS = 64
#: Bits of a set that tell odd counts.
PARITY = 2048
#: Points of a leaf, leaves of a tile.
LEAF, FANOUT = 32, 32
#: Sizes of a class grow by this factor, in halves.
GROWTH_HALVES = 3
_OTHER = 0xC2B2AE3D27D4EB4F


def differing(a, b, threshold: int):
    """Shingles in one of two sets of sizes a and b alone, at most, if they reach the threshold."""
    return (a + b) * (100 - threshold) // (100 + threshold)


def size_classes(most: int, threshold: int) -> list[tuple[int, int, int]]:
    """(smallest larger size, end, groups) of each class up to size `most`; below the first, only equal sets link."""
    out: list[tuple[int, int, int]] = []
    at = 1
    while at <= most and not differing(at, at, threshold):
        at += 1
    while at <= most:
        end = max(at + 1, at * GROWTH_HALVES // 2)
        out.append((at, end, int(differing(end - 1, end - 1, threshold)) + 1))
        at = end
    return out


def _sets(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, the text of each, and the sets' sizes."""
    key, count = shingles(raw, n)
    doc = np.repeat(np.arange(len(raw)), count)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, doc, np.bincount(doc, minlength=len(raw)).astype(np.int64)


def tree_keys(key: np.ndarray, doc: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The trees of each text (in order of texts), and how many it has; texts may be in two classes."""
    found, owner = [], []
    for k, (low, end, parts) in enumerate(size_classes(int(size.max(initial=0)) * 100 // threshold + 1, threshold)):
        mine = np.flatnonzero((100 * size >= threshold * low) & (size < end))
        if not len(mine):
            continue
        slot = np.full(len(size), -1)
        slot[mine] = np.arange(len(mine))
        here = slot[doc]
        h, here = key[here >= 0], here[here >= 0]
        part = ((mix(h ^ U(0x9E3779B97F4A7C15 + 2 * k)) >> U(32)) * U(parts)) >> U(32)
        content = np.zeros(len(mine) * parts, U)
        np.add.at(content, here * parts + part.astype(np.int64), mix(h + U(_OTHER)))
        of = mix(np.arange(parts, dtype=U) + U((k + 1) << 32))
        found.append(mix(content ^ np.tile(of, len(mine))))
        owner.append(np.repeat(mine, parts))
    if not found:
        return np.empty(0, np.int64), np.zeros(len(size), np.int64)
    keys, who = np.concatenate(found), np.concatenate(owner)
    return keys[np.argsort(who, kind="stable")].astype(np.int64), np.bincount(who, minlength=len(size))


def signatures(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, point, bits, trees): the set's size, a 128-bit fingerprint, its counts by group, their parities by finer groups, and the trees it is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, at = batch.column("doc_id"), batch.column("_text"), 0
            while at < batch.num_rows:  # a few rows at a time as text, whatever a batch holds
                texts = [x or b"" for x in column.slice(at, 256).to_pylist()]
                for a, b in groups(texts):
                    key, doc, size = _sets(texts[a:b], n)
                    point = np.bincount(doc * GROUPS + (mix(key) >> U(58)).astype(np.int64), minlength=(b - a) * GROUPS).astype(np.int32).reshape(-1, GROUPS)
                    odd = np.bincount(doc * PARITY + (mix(key + U(_OTHER)) % U(PARITY)).astype(np.int64), minlength=(b - a) * PARITY).reshape(-1, PARITY) & 1
                    f1, f2 = np.zeros(b - a, U), np.zeros(b - a, U)
                    np.add.at(f1, doc, key)
                    np.add.at(f2, doc, mix(key ^ U(_OTHER)))
                    trees, count = tree_keys(key, doc, size, threshold)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(trees, pa.int64()))
                    cols = [ids.slice(at + a, b - a), pa.array(size), pa.array(f1.astype(np.int64)), pa.array(f2.astype(np.int64)), pa.array([p.tobytes() for p in point], pa.binary()), pa.array([p.tobytes() for p in np.packbits(odd.astype(np.uint8), axis=1)], pa.binary()), lists]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "f1", "f2", "point", "bits", "trees"])
                at += 256

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, point binary, bits binary, trees array<long>")


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, GROUPS)


def _odd(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, PARITY // 64)


def _like(bits: np.ndarray, bits2: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs of sets, with so many members together, differ in few enough bits to reach the threshold."""
    return (100 + threshold) * np.bitwise_count(bits ^ bits2).sum(axis=1, dtype=np.int64) <= (100 - threshold) * sizes


def bounded(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs (x, y) whose summed coordinate minima and bits can reach the threshold."""
    side = lambda name: reps.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("point").alias(f"p{name}"), F.col("bits").alias(f"b{name}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").where(100 * F.least("nx", "ny") >= threshold * F.greatest("nx", "ny"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.minimum(_points(batch.column("px")), _points(batch.column("py"))).sum(axis=1)
            size = np.asarray(batch.column("nx")) + np.asarray(batch.column("ny"))
            yes = pa.array(((100 + threshold) * shared >= threshold * size) & _like(_odd(batch.column("bx")), _odd(batch.column("by")), size, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(yes) for c in ("x", "y")], names=["x", "y"])

    return both.select("x", "y", "nx", "ny", "px", "py", "bx", "by").mapInArrow(run, pairs.select("x", "y").schema).distinct()


def _interleaved(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes that are near for near points: four bits of each of eight sums of coordinates, relative to the size, high bits first."""
    coarse = points.reshape(-1, 8, GROUPS // 8).sum(axis=2) * 64 // np.maximum(size, 1)[:, None]
    coarse = np.minimum(coarse, 15).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for bit in (3, 2, 1, 0):
        for k in range(8):
            code = code << 1 | (coarse[:, k] >> bit & 1)
    return code


def placed(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """(tree, band, code, node, label, size, point, bits) of the members (tree, node, label): where each stands in its tree's order. Without `bits` in `reps`, points alone decide."""
    bits = F.col("bits") if "bits" in reps.columns else F.lit(None).cast("binary").alias("bits")
    rows = open_.join(reps.select("node", F.col("n_shingles").alias("size"), "point", bits), "node").select("tree", "node", "label", "size", "point", "bits")
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size"))
            band = (np.log(np.maximum(size, 1)) * 16).astype(np.int64)  # sizes within some 6 percent
            code = _interleaved(_points(batch.column("point")), size)
            yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array(band), pa.array(code), *[batch.column(c) for c in ("node", "label", "size", "point", "bits")]], names=["tree", "band", "code", "node", "label", "size", "point", "bits"])

    return rows.mapInArrow(run, f"tree long, band long, code long, node {kind}, label {kind}, size long, point binary, bits binary")


def tiles(rows: DataFrame) -> DataFrame:
    """(tree, tile, lo, hi, n_lo, n_hi, one, nodes, labels, sizes, points, bits): runs of at most LEAF * FANOUT points of one tree in its order, with their box; `one` is their label if they have one alone.

    Ranges of the order go to partitions, so a large tree spreads over tasks.
    """
    kind = rows.schema["node"].dataType.simpleString()
    order = ["tree", "band", "code", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(parts).combine_chunks()
            points, size = _points(t.column("point").combine_chunks()), np.asarray(t.column("size"))
            label, bits = t.column("label").combine_chunks(), t.column("bits")
            one = label[0] if len(label.unique()) == 1 else None
            lists = lambda c: pa.array([t.column(c).to_pylist()], pa.list_(t.schema.field(c).type))
            made += 1
            cols = [
                t.column("tree").combine_chunks().slice(0, 1), pa.array([(part << 32) + made], pa.int64()), pa.array([points.min(axis=0).tolist()], pa.list_(pa.int32())), pa.array([points.max(axis=0).tolist()], pa.list_(pa.int32())),
                pa.array([size.min()], pa.int64()), pa.array([size.max()], pa.int64()), pa.array([one.as_py() if one is not None else None], label.type), lists("node"), lists("label"), lists("size"), pa.array([points.tobytes()], pa.binary()), pa.array([None if bits.null_count else b"".join(bits.to_pylist())], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["tree", "tile", "lo", "hi", "n_lo", "n_hi", "one", "nodes", "labels", "sizes", "points", "bits"])

        for batch in batches:
            tree = np.asarray(batch.column("tree"))
            at = 0
            while at < len(tree):
                have = sum(b.num_rows for b in held)
                if held and (have == LEAF * FANOUT or held[0].column("tree")[0].as_py() != tree[at]):
                    yield tile(held)
                    held, have = [], 0
                end = min(int(np.searchsorted(tree, tree[at], side="right")), at + LEAF * FANOUT - have)
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield tile(held)

    schema = f"tree long, tile long, lo array<int>, hi array<int>, n_lo long, n_hi long, one {kind}, nodes array<{kind}>, labels array<{kind}>, sizes array<long>, points binary, bits binary"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "node", "label", "size", "point", "bits").mapInArrow(run, schema)


def _boxes(points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    cut = np.arange(0, len(points), LEAF)
    return np.minimum.reduceat(points, cut), np.maximum.reduceat(points, cut), np.minimum.reduceat(size, cut), np.maximum.reduceat(size, cut)


def _met(p: tuple, q: tuple | None, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two tiles (or, without q, of one) that different labels, sizes, summed minima and bits leave, by leaves. p, q: (points, sizes, label numbers, bits or none)."""
    one, q = q is None, q or p
    (points, size, label, bits), (points2, size2, label2, bits2) = p, q
    (lo, hi, small, big), (lo2, hi2, small2, big2) = _boxes(points, size), _boxes(points2, size2)
    for i in range(len(lo)):
        shared = np.minimum(hi[i], hi2).sum(axis=1)
        apart = np.maximum(np.maximum(lo[i] - hi2, lo2 - hi[i]), 0).sum(axis=1)
        near = ((100 + threshold) * shared >= threshold * (small[i] + small2)) & ((100 + threshold) * apart <= (100 - threshold) * (big[i] + big2))
        near &= (100 * big[i] >= threshold * small2) & (100 * big2 >= threshold * small[i])
        if one:
            near[:i] = False
        rows = np.arange(i * LEAF, min((i + 1) * LEAF, len(points)))
        for j in np.flatnonzero(near).tolist():
            cols = np.arange(j * LEAF, min((j + 1) * LEAF, len(points2)))
            shared = np.minimum(points[rows][:, None, :], points2[cols][None, :, :]).sum(axis=2)
            yes = ((100 + threshold) * shared >= threshold * (size[rows][:, None] + size2[cols])) & (label[rows][:, None] != label2[cols])
            a, b = np.nonzero(yes)
            a, b = rows[a], cols[b]
            if one:
                a, b = a[a < b], b[a < b]
            if bits is not None and bits2 is not None and len(a):
                like = _like(bits[a], bits2[b], size[a] + size2[b], threshold)
                a, b = a[like], b[like]
            if len(a):
                yield a, b


def tree_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """(x, y): every pair of points of one tree with different labels that the bounds leave."""
    kind = rows.schema["node"].dataType.simpleString()
    packed = written(tiles(rows), "tiles")
    other = packed.select("tree", *[F.col(c).alias(f"{c}_y") for c in packed.columns if c != "tree"])
    shared = F.aggregate(F.zip_with("hi", "hi_y", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, x: s + x)
    able = (F.col("tile") < F.col("tile_y")) & (100 * F.col("n_hi") >= threshold * F.col("n_lo_y")) & (100 * F.col("n_hi_y") >= threshold * F.col("n_lo"))
    able = able & ((100 + threshold) * shared >= threshold * (F.col("n_lo") + F.col("n_lo_y"))) & F.coalesce(F.col("one") != F.col("one_y"), F.lit(True))
    names = ["nodes", "labels", "sizes", "points", "bits"]
    two = packed.join(other, "tree").where(able).select(*names, *[f"{c}_y" for c in names])
    alone = packed.where("one IS NULL").select(*names, *[F.lit(None).cast(packed.schema[c].dataType).alias(f"{c}_y") for c in names])

    def side(batch: pa.RecordBatch, i: int, end: str) -> tuple | None:
        if batch.column(f"nodes{end}")[i].as_py() is None:
            return None
        points = np.frombuffer(batch.column(f"points{end}")[i].as_py(), np.int32).reshape(-1, GROUPS)
        bits = batch.column(f"bits{end}")[i].as_py()
        bits = None if bits is None else np.frombuffer(bits, U).reshape(-1, PARITY // 64)
        return points, np.asarray(batch.column(f"sizes{end}")[i].values), batch.column(f"labels{end}")[i].values, batch.column(f"nodes{end}")[i].values, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q = side(batch, i, ""), side(batch, i, "_y")
                number = pa.concat_arrays([p[2], q[2]] if q else [p[2]]).dictionary_encode().indices.to_numpy()
                one = (p[0], p[1], number[: len(p[0])], p[4])
                two_ = (q[0], q[1], number[len(p[0]) :], q[4]) if q else None
                for a, b in _met(one, two_, threshold):
                    yield pa.RecordBatch.from_arrays([p[3].take(pa.array(a)), (q or p)[3].take(pa.array(b))], names=["x", "y"])

    return two.union(alone).mapInArrow(run, f"x {kind}, y {kind}")


def joined(docs: DataFrame, n: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; shingles of n words, similarity of `threshold` percent (of 1 to 100)."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, n, threshold), "sets")
    live = sigs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(live.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("node")), "classes")
    # The first row of a class by id stands for it; rows that share its id and set are equal.
    reps = live.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "n_shingles", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "n_shingles", "f1", "f2"])
    reps = written(reps.select(F.col("doc_id").alias("node"), "n_shingles", "point", "bits", "trees"), "points")

    dealt = reps.select(F.explode("trees").alias("tree"), "node")
    shared = dealt.groupBy("tree").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("held")).where("least <> most")
    members = written(dealt.join(shared.select("tree", "least", "held"), "tree"), "members")
    needed = members.select("node").distinct()
    whole = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).where(F.col("node").isNotNull())
    texts = written(whole.join(needed, "node", "left_semi"), "candidate-texts")

    first = members.where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y")).distinct()
    tested, paths = written(bounded(first, reps, threshold), "tested"), []
    links = written(confirmed(tested, texts, n, threshold), "links")
    for last in (False, True):
        labels = components(links)
        at = members.join(labels, "node", "left").select("tree", "held", "node", F.coalesce("label", "node").alias("label"))
        open_ = at.groupBy("tree").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("tree")
        at, path = written_at(at.join(open_, "tree"), "open")
        paths.append(path)
        if last:
            order, path = written_at(placed(at.select("tree", "node", "label"), reps), "placed")
            paths.append(path)
            pairs = tree_pairs(order, threshold)
        else:
            fellows = members.groupBy("node").agg(F.sum("held").alias("fellows"))
            pivots = at.join(fellows, "node").groupBy("tree").agg(F.max_by(F.struct("node", "label"), F.struct("fellows", "node")).alias("p")).select("tree", F.col("p.node").alias("y"), F.col("p.label").alias("other"))
            pairs = at.withColumnRenamed("node", "x").join(pivots, "tree").where("label <> other").select("x", "y")
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(tested, ["x", "y"], "left_anti")
        pairs = written(pairs if last else bounded(pairs, reps, threshold), "tested")
        found = written(confirmed(pairs, texts, n, threshold), "links")
        links, tested = links.union(found), tested.union(pairs)
    labels = components(links)
    dropped(spark, *paths)

    of_class = classes.join(labels, "node", "left").select("n_shingles", "f1", "f2", F.coalesce("label", "node").alias("component_id"))
    linked = live.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    alone = sigs.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def query(docs: DataFrame) -> DataFrame:
    return joined(docs)
