"""Copies among images by local descriptors.

Corners are found at several scales, as many as an image's area has: each is the greatest of its neighbourhood, and no count is capped.
Around each, orientation is taken from the intensity centroid, and pairs of places turned by it are compared, one bit a pair. The pairs are chosen once, from
a pool, so that their bits are even and do not follow each other on drawn pictures; bits that follow the corner's shape alone would agree among
unrelated images. Descriptors match if they differ in at most MAX_BITS bits. They are indexed by PARTS parts of theirs, a table each; as there are more
parts than bits that may differ, matching descriptors share a part, so the tables find every match. Images are linked when enough distinct
corners agree on one change of scale, one turn and one shift, which crops, turns, smaller copies and edits keep.

Equal images are one before anything is indexed. First every image of a bucket is compared with the bucket's smallest image, if they share
enough corners there; groups are the connected components of the links. Then every pair of images of different groups that shares a bucket is considered: a bucket
of more than RARE images is frequent, and images that have fewer than LEAST_CORNERS corners in frequent buckets must share a rare one
with whatever they link to. So pairs come from rare buckets, whose size is bounded, and for the others from frequent ones. Pairs are dropped only
if the corners in buckets they share cannot be enough; the rest are compared corner by corner.

Media are binary greyscale PGM ("P5"). Cases: null, empty and malformed media have no corners and stay alone; an image smaller than a
patch has none either; images without an id stay alone and have no class; repeated rows are equal images; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .minhash import components
from .vector import U, mix

SCALES = (1, 2)
RADIUS, MARGIN, BITS, TURNS = 8, 11, 256, 36
#: A corner is the greatest within so many pixels, at each scale.
APART = 5
MAX_BITS, PARTS, LEAST_CORNERS = 5, 6, 6
#: Votes: turns in bins of this part of a circle, shifts in bins of so many pixels, on two grids.
TURN_BINS, SHIFT_BIN = 15, 8
RARE = 16
#: Tests are chosen from so many, on corners of so many drawn pictures.
POOL, PICTURES = 2500, 150

_turn = np.arange(TURNS) * 2 * np.pi / TURNS
_rotation = np.stack([np.stack([np.cos(_turn), -np.sin(_turn)], 1), np.stack([np.sin(_turn), np.cos(_turn)], 1)], 1)
_disc = np.array([(x, y) for x in range(-7, 8) for y in range(-7, 8) if x * x + y * y <= 49])


def _turned(tests: np.ndarray) -> np.ndarray:
    """Places of the tests for each turn: [turn, bit, end, (x, y)]."""
    return np.round(np.einsum("tij,bej->tbei", _rotation, tests)).astype(np.int64)


@lru_cache(maxsize=1)
def places() -> np.ndarray:
    """The chosen tests: evenest bits first, each only if it follows none before it much."""
    rng = np.random.default_rng(77)
    pool = np.round(rng.uniform(-RADIUS, RADIUS, (4 * POOL, 2, 2)))
    length = np.hypot(pool[..., 0], pool[..., 1])
    pool = pool[(length.max(axis=1) <= RADIUS) & (np.abs(pool[:, 0] - pool[:, 1]).sum(axis=1) > 0)][:POOL]
    stack = np.stack([decode(drawn(v.tolist(), 0)) for v in rng.normal(0, 0.12, (PICTURES, 64))]).astype(float)
    i, v, u, _ = corners(stack)
    bits = _tested(stack, i, v, u, _angles(stack, i, v, u), _turned(pool))
    even = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")
    z = (bits - bits.mean(axis=0)) / (bits.std(axis=0) + 1e-9)
    alike = np.abs(z.T @ z) / len(z)
    for most in (0.35, 0.5, 0.65, 0.8, 1.1):
        chosen: list[int] = []
        for k in even.tolist():
            if len(chosen) < BITS and (not chosen or alike[k, chosen].max() < most):
                chosen.append(k)
        if len(chosen) == BITS:
            break
    return _turned(pool[chosen])


def decode(media: bytes | None) -> np.ndarray | None:
    """The pixels of a PGM, or None."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", media or b"")
    if not head:
        return None
    w, h, most = map(int, head.groups())
    data = media[head.end() :]
    if most > 255 or len(data) < w * h or not w * h:
        return None
    return np.frombuffer(data, np.uint8, w * h).reshape(h, w)


def encode(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5 %d %d 255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r + 1 pixels; edges repeat."""
    x = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (x[:, k:, k:] - x[:, :-k, k:] - x[:, k:, :-k] + x[:, :-k, :-k]) / (k * k)


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column, strength) of the corners of a stack of images."""
    gx, gy = np.zeros_like(x), np.zeros_like(x)
    gx[:, :, 1:-1], gy[:, 1:-1] = x[:, :, 2:] - x[:, :, :-2], x[:, 2:] - x[:, :-2]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = np.round(a * b - c * c - 0.05 * (a + b) ** 2, 3)
    best = r
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (APART, APART)
        p = np.pad(best, pad, constant_values=-np.inf)
        best = np.max([np.take(p, range(k, k + r.shape[axis]), axis=axis) for k in range(2 * APART + 1)], axis=0)
    good = (r == best) & (r > 1e3)
    good[:, :MARGIN], good[:, -MARGIN:], good[:, :, :MARGIN], good[:, :, -MARGIN:] = False, False, False, False
    i, v, u = np.nonzero(good)
    return i, v, u, r[i, v, u]


def _angles(x: np.ndarray, i: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    disc = x[i[:, None], v[:, None] + _disc[:, 1], u[:, None] + _disc[:, 0]]
    return np.arctan2((disc * _disc[:, 1]).sum(1), (disc * _disc[:, 0]).sum(1))


def _tested(x, i, v, u, angle: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of each corner, for tests `at` by turn."""
    turn = np.round(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
    smooth = np.round(_box(x, 1), 3)
    out = np.empty((len(i), at.shape[1]), bool)
    for k in range(0, len(i), 4096):
        p, q, w, own = i[k : k + 4096, None, None], v[k : k + 4096, None, None], u[k : k + 4096, None, None], at[turn[k : k + 4096]]
        value = smooth[p, q + own[..., 1], w + own[..., 0]]
        out[k : k + 4096] = value[..., 0] < value[..., 1]
    return out


def described(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, column, angle, descriptor) of a stack's corners; descriptors are 32 bytes."""
    i, v, u, _ = corners(x)
    angle = _angles(x, i, v, u) if len(i) else np.empty(0)
    bits = _tested(x, i, v, u, angle, places()) if len(i) else np.empty((0, BITS), bool)
    return i, v, u, angle, np.packbits(bits, axis=1)


#: A corner in a packed list of them.
POINT = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "<i4"), ("angle", "<f4"), ("bits", "u1", BITS // 8)])


def points(images: DataFrame) -> DataFrame:
    """(image, digest, blank, n, points) of each image (image, media): its bytes' SHA-256, whether it has none, and its corners, packed.

    One pass: pictures themselves are never dealt or written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                media = part.column("media").to_pylist()
                by_shape: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
                for row, x in enumerate(media):
                    if (p := decode(x)) is not None:
                        by_shape.setdefault(p.shape, []).append((row, p))
                found = [b""] * len(media)
                for (h, w), own in by_shape.items():
                    step = max(1, 600_000 // (h * w))
                    for a in range(0, len(own), step):
                        for (row, _), blob in zip(own[a : a + step], _packed([p for _, p in own[a : a + step]], h, w), strict=True):
                            found[row] = blob
                yield pa.RecordBatch.from_arrays(
                    [part.column("image"), pa.array([hashlib.sha256(x or b"").digest() for x in media], pa.binary()), pa.array([not x for x in media]), pa.array([len(x) // POINT.itemsize for x in found], pa.int32()), pa.array(found, pa.binary())],
                    names=["image", "digest", "blank", "n", "points"],
                )

    return images.select(F.col("image").cast("long").alias("image"), "media").mapInArrow(run, "image long, digest binary, blank boolean, n int, points binary")


def _packed(pixels: list[np.ndarray], h: int, w: int) -> list[bytes]:
    """The packed corners of images of one shape."""
    stack = np.stack(pixels).astype(float)
    which, rows = [np.empty(0, np.int64)], [np.empty(0, POINT)]
    for scale in SCALES:
        hh, ww = h // scale, w // scale
        if min(hh, ww) <= 2 * MARGIN:
            continue
        small = stack[:, : hh * scale, : ww * scale].reshape(len(stack), hh, scale, ww, scale).mean((2, 4))
        i, v, u, angle, bits = described(small)
        found = np.empty(len(i), POINT)
        found["x"], found["y"], found["scale"], found["angle"], found["bits"] = u * scale, v * scale, scale, angle, bits
        which.append(i)
        rows.append(found)
    which_ = np.concatenate(which)
    all_ = np.concatenate(rows)[np.argsort(which_, kind="stable")]
    end = np.cumsum(np.bincount(which_, minlength=len(stack)))
    return [x.tobytes() for x in np.split(all_, end[:-1])]


def keys(found: DataFrame) -> DataFrame:
    """(key, image, point): a key for each part of each descriptor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("points").to_pylist()), POINT)["bits"], axis=1)
            parts = [np.packbits(x, axis=1).astype(U) for x in np.array_split(bits, PARTS, axis=1)]
            key = np.stack([mix((x * (U(256) ** np.arange(x.shape[1], dtype=U))).sum(axis=1, dtype=U) + U(k << 60)) for k, x in enumerate(parts)], axis=1)
            image = np.repeat(np.repeat(batch.column("image").to_numpy(zero_copy_only=False), n), PARTS)
            point = np.repeat(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(image, pa.int64()), pa.array(point.astype(np.int32))], names=["key", "image", "point"])

    return found.mapInArrow(run, "key long, image long, point int")


_BITS_OF = np.array([k.bit_count() for k in range(256)], np.uint8)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many distinct corners of two images match and agree on a change of scale, a turn and a shift."""
    i, j = [], []
    for k in range(0, len(a), 256):
        apart = _BITS_OF[a["bits"][k : k + 256, None] ^ b["bits"][None]].sum(axis=2)
        p, q = np.nonzero(apart <= MAX_BITS)
        i.append(p + k)
        j.append(q)
    i, j = np.concatenate(i), np.concatenate(j)
    if len(i) < LEAST_CORNERS:
        return 0
    ratio = b["scale"][j] / a["scale"][i]
    turn = (b["angle"][j] - a["angle"][i]).astype(float)
    c, s = np.cos(turn), np.sin(turn)
    x = b["x"][j] - ratio * (c * a["x"][i] - s * a["y"][i])
    y = b["y"][j] - ratio * (s * a["x"][i] + c * a["y"][i])
    most = 0
    for grid in (0.0, 0.5):
        cells = np.stack((ratio, np.floor(turn / (2 * np.pi) * TURN_BINS + 0.25 + grid) % TURN_BINS, np.floor(x / SHIFT_BIN + grid), np.floor(y / SHIFT_BIN + grid)), axis=1)
        _, cell = np.unique(cells, axis=0, return_inverse=True)
        cell = cell.ravel()
        count = [np.bincount(np.unique(np.stack((cell, side), axis=1), axis=0)[:, 0]) for side in (i, j)]
        most = max(most, int(np.minimum(*count).max()))
    return most


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (x, y) of images on which enough corners agree."""
    side = lambda s: found.select(F.col("image").alias(s), F.col("points").alias(f"p{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [agreeing(np.frombuffer(p, POINT), np.frombuffer(q, POINT)) >= LEAST_CORNERS for p, q in zip(batch.column("px").to_pylist(), batch.column("py").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(yes, pa.bool_())) for c in ("x", "y")], names=["x", "y"])

    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "px", "py").mapInArrow(run, "x long, y long")


def _shared(left: DataFrame, right: DataFrame, order) -> DataFrame:
    """(x, y, n): pairs from rows (key, image, point, group), and how many distinct corners of either they share buckets with at least."""
    other = right.select(F.col("key").alias("key_y"), F.col("image").alias("y"), F.col("point").alias("py"), F.col("group").alias("group_y"))
    met = left.join(other, (F.col("key") == F.col("key_y")) & (F.col("group") != F.col("group_y")) & order)
    met = met.groupBy(F.col("image").alias("x"), "y").agg(F.count_distinct("point").alias("nx"), F.count_distinct("py").alias("ny"))
    return met.select("x", "y", F.least("nx", "ny").alias("n"))


def links(found: DataFrame) -> DataFrame:
    """(x, y) of images that enough corners link; groups of them are connected, though not every pair of a group is listed."""
    keyed = keys(found)
    shared = keyed.groupBy("key").agg(F.min("image").alias("least"), F.max("image").alias("most")).where("least <> most").select("key", "least")
    rows = written(keyed.join(shared, "key"), "image-keys")
    least = rows.where("image = least").withColumn("group", F.col("image"))
    star = _shared(least, rows.withColumn("group", F.col("image")), F.lit(True)).where(F.col("n") >= LEAST_CORNERS)
    first = written(verified(star, found), "image-links")

    rows = rows.join(components(first), rows["image"] == F.col("node"), "left").select("key", "image", "point", F.coalesce("label", "image").alias("group"))
    open_ = rows.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.count(F.lit(1)).alias("rows")).where("a <> b").select("key", (F.col("rows") > RARE).alias("frequent"))
    rows = written(rows.join(open_, "key"), "image-open")
    often = rows.where("frequent").groupBy("image").agg(F.count_distinct("point").alias("often"))
    often = written(often, "image-often")
    up = F.col("image") < F.col("y")
    rare = rows.where(~F.col("frequent"))
    sparse = _shared(rare, rare, up)
    for s in ("x", "y"):
        sparse = sparse.join(often.select(F.col("image").alias(s), F.col("often").alias(f"often_{s}")), s, "left")
    sparse = sparse.where(F.col("n") + F.least(F.coalesce("often_x", F.lit(0)), F.coalesce("often_y", F.lit(0))) >= LEAST_CORNERS)
    heavy = rows.where("frequent").join(often.where(F.col("often") >= LEAST_CORNERS).select("image"), "image", "left_semi")
    dense = _shared(heavy, heavy, up).where(F.col("n") >= LEAST_CORNERS)
    pairs = written(sparse.select("x", "y").union(dense.select("x", "y")).distinct(), "image-pairs")
    return first.union(written(verified(pairs, found), "image-links"))


def copies(images: DataFrame) -> DataFrame:
    """(image, class_id, kept, n_corners) of images (image, media): the smallest image of its group, whether it is that one, and its corners."""
    facts = written(points(images), "image-facts")
    named = facts.where("image IS NOT NULL")
    of = written(named.groupBy("digest").agg(F.min("image").alias("first")), "image-classes")
    firsts = named.where("n > 0").groupBy("digest").agg(F.min_by(F.struct("image", "n", "points"), "image").alias("f"))
    found = written(firsts.select("f.image", "f.n", "f.points"), "image-points")
    label = components(links(found)).select(F.col("node").alias("first"), "label")
    rows = facts.select("image", "digest", "blank", F.col("n").cast("long").alias("n")).join(of, "digest", "left").join(label, "first", "left")
    alone = F.col("blank") | F.col("image").isNull()
    rows = rows.select("image", F.when(alone, F.col("image")).otherwise(F.coalesce("label", "first")).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_corners"))
    return rows.select("image", "class_id", F.col("image").eqNullSafe(F.col("class_id")).alias("kept"), "n_corners")


def drawn(vector: list[float] | None, variant: int, side: int = 72) -> bytes | None:
    """A picture of a vector: a field of blocks with texture; variant 1 is a crop of it, 2 a brighter one with a bar across."""
    if not vector:
        return None
    v = np.nan_to_num(np.asarray(vector, np.float64))
    rng = np.random.default_rng(np.abs(np.round(v * 1e6)).astype(np.uint64))
    grid = 128 + 300 * np.resize(v, (6, 6))
    pixels = np.kron(grid, np.ones((side // 6, side // 6)))
    for _ in range(10):
        y, x, h, w = rng.integers(0, side - 12), rng.integers(0, side - 12), rng.integers(5, 14), rng.integers(5, 14)
        pixels[y : y + h, x : x + w] += rng.choice([-70, 70])
    pixels = np.clip(pixels + rng.normal(0, 8, (side, side)), 20, 200).round()
    if variant == 1:
        pixels = pixels[6:, 8:]
    if variant == 2:
        pixels = np.minimum(pixels * 1.1 + 10, 255).round()
        pixels[-10:-6] = 0
    return encode(pixels)


def pictures(embeddings: DataFrame, every: int = 8) -> DataFrame:
    """(image, media): a picture of each vector, and of every eighth a crop and an edit too; image = 4 * vec_id + variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [(None if i is None else 4 * i + k, drawn(v, k)) for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True) for k in ((0, 1, 2) if i is not None and i % every == 0 else (0,))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["image", "media"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "image long, media binary")


def query(embeddings: DataFrame) -> DataFrame:
    """The tables hold no media, so their vectors are drawn: the copies that must be found are known."""
    return copies(pictures(embeddings)).withColumnRenamed("image", "image_id")
