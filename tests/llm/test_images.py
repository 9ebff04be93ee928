"""Copies that are known must be found, and nothing else; links against all pairs."""

import numpy as np

from glossa.llm import images


def vectors(n, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.12, 64).tolist()) for i in range(n)]


def test_crops_and_edits_are_found_and_others_stay_apart(spark):
    rows = vectors(120)
    rows[17] = (17, rows[16][1])  # an equal vector
    rows.append((None, rows[3][1]))
    rows.append((500, None))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, image int")
    got = {r.image_id: (r.class_id, r.kept) for r in images.query(df).collect()}
    assert len(got) == 120 + 2 * 15 + 2
    assert all(got[4 * i + k] == (4 * i, False) for i in range(0, 120, 8) for k in (1, 2))
    assert got[68] == (64, False) and got[None] == (None, True) and got[2000] == (2000, True)
    assert all(got[4 * i] == (4 * i, True) for i in range(120) if i != 17)


def patched(rng, base, side):
    """A picture whose left half is another's, or which shares a small piece with many."""
    own = images.decode(images.drawn(rng.normal(0, 0.12, 64).tolist(), 0, side)).copy()
    own[:, : base.shape[1]] = base[: own.shape[0]]
    return own


def test_groups_against_all_pairs(spark, monkeypatch):
    """Turned, smaller, cropped and noisy copies, and a piece of few corners that all pictures share, with buckets that are soon frequent."""
    monkeypatch.setattr(images, "RARE", 4)
    rng = np.random.default_rng(12)
    side = 144
    pixels = [images.decode(images.drawn(v, 0, side)).astype(float) for _, v in vectors(14, seed=9)]
    logo = images.decode(images.drawn(vectors(1, seed=77)[0][1], 0, 72))[:34, :34]
    for p in pixels:
        p[-34:, -34:] = logo
    pixels += [np.rot90(pixels[0]), pixels[1][17:, 9:], pixels[2].reshape(72, 2, 72, 2).mean((1, 3)), np.clip(pixels[3] + rng.normal(0, 0.4, (side, side)), 0, 255), pixels[4][:, ::-1]]
    media = [(k, images.encode(np.round(p))) for k, p in enumerate(pixels)]
    df = spark.createDataFrame(media, "image long, media binary")
    found = {r.image: np.frombuffer(r.points, images.POINT) for r in images.points(df).collect()}
    group = {k: k for k, _ in media}
    linked = set()
    for x in group:
        for y in group:
            if x < y and images.agreeing(found[x], found[y]) >= images.LEAST_CORNERS:
                linked.add((x, y))
                low, high = sorted((group[x], group[y]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {(0, 14), (1, 15), (2, 16)} <= linked and not any(y < 14 for _, y in linked)
    got = {r.image: r.class_id for r in images.copies(df).collect()}
    assert got == group


def test_corners_grow_with_the_area():
    small, large = (len(images.corners(images.decode(images.drawn(vectors(1)[0][1], 0, side)).astype(float)[None])[0]) for side in (72, 288))
    assert large > 8 * small


def test_parts_find_every_match():
    assert images.MAX_BITS < images.PARTS < 16 and -(-images.BITS // images.PARTS) <= 56  # a key holds a part's bits and its number


def test_odd_media(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, b"P5 2 2 255\n\0\0\0\0"), (5, b"P5 2 2 255\n\0\0\0\0"), (6, b"P5 9 9 255\nxx")], "image long, media binary")
    got = {r.image: (r.class_id, r.n_corners) for r in images.copies(df).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (4, 0), 6: (6, 0)}
    assert images.copies(df.limit(0)).collect() == []
