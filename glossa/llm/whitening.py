"""Whitening of vectors by their leading covariance components, found by block Lanczos without the covariance matrix.

Entries become integers on a grid. The fit list, every distinct integer vector once, is written as packed bytes. Its count and sums are exact. The
leading eigenvectors of the covariance V come from a block Krylov basis: one distributed pass over the fit list gives VQ for a whole block Q, as sums
over rows of c(c'Q) with c the centred row, and V itself is never formed. Every new block is orthogonalised twice against all earlier ones; columns that
vanish (breakdown) start again from random directions outside the basis, until that is as wide as the vectors. After each pass the small projected
problem is solved on the driver, and the search ends when the residuals of the wanted pairs, |VQy - eQy|, are at the level of rounding, or the basis is whole.

The trace, for the explained shares, comes from the exact integer deviations of the fit list, and so needs no eigenvalue.

What the driver holds is bounded by the width of the vectors: sums, blocks and the basis. Passes emit one partial block a task; Spark adds them by coordinate.

Cases: rows with a null vector or null or non-finite entries go; rows with a null id stay. Shorter vectors count as if zeros followed, up to the
table's greatest width. Grid values beyond 64 bits stop at their limits; a deviation that no long can hold is null. Components with an eigenvalue of zero (to rounding)
cannot be scaled and are not returned, so equal vectors, a single one or none give no rows. Repeated rows count once in the fit and are returned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Grid steps of one unit, and components returned.
STEPS, COMPONENTS = 256, 4
#: Columns of a block; the wanted components and as many again, so that clusters converge together.
BLOCK = 8
#: A residual of this share of the greatest eigenvalue is rounding.
TOLERANCE = 1e-14
_LONG = 2**63 - 1
#: Rows that are worked on at once.
_ROWS = 2048


def _grid(column: pa.Array) -> np.ndarray:
    """Integer vectors of equally long lists, a row each."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        at = np.floor(flat * STEPS)
    out = np.clip(at, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(at >= 2.0**63, _LONG, out)


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes in the narrowest of 2, 4 or 8 bytes an entry that holds them all, without trailing zeros; equal vectors give equal bytes."""
    most = np.abs(np.where(x == -_LONG - 1, _LONG, x)).max(axis=1, initial=0)
    last = np.where((x != 0).any(axis=1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0) if x.shape[1] else np.zeros(len(x), int)
    out = []
    for row, m, k in zip(x, most.tolist(), last.tolist(), strict=True):
        kind = "<i2" if m < 2**15 else "<i4" if m < 2**31 else "<i8"
        out.append(kind[2].encode() + row[:k].astype(kind).tobytes())
    return out


def _unpack(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for i, b in enumerate(packed):
        row = np.frombuffer(b, f"<i{b[:1].decode()}", offset=1)
        out[i, : len(row)] = row
    return out


def on_grid(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x): packed integer vectors of the rows whose vector is whole and finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("_v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = rows.select("vec_id", v.alias("_v")).where(F.col("_v").isNotNull()).where(~bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                column = part.column("_v")
                width = np.diff(np.asarray(column.offsets))
                packed: list[bytes | None] = [None] * len(width)
                for w in np.unique(width).tolist():  # as a rule one
                    at = np.flatnonzero(width == w)
                    for i, b in zip(at.tolist(), _pack(_grid(column.take(pa.array(at)))), strict=True):
                        packed[i] = b
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(packed, pa.binary()), pa.array(width, pa.int32())], names=["vec_id", "x", "width"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary, width int")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over coordinates of (n*x - sum)**2, exact."""
    far = max((abs(s) for s in sums), default=0) + n * int(np.abs(x.astype(np.float64)).max(initial=0))
    if far * far * max(1, x.shape[1]) < 2**62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def _summed(fit: DataFrame, partial: Callable[[list[bytes]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over the fit list of `partial`: each task adds up its rows, Spark adds the tasks by coordinate, and only the sum reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                total += partial(batch.column("x").slice(i, _ROWS).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    rows = fit.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        out[r.at] = r.value
    return out.reshape(shape)


def _outside(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns that span what of `block` lies outside `basis`, and their coefficients; vanished columns are drawn anew, with none."""
    width, wanted = block.shape
    coefficient = np.zeros((wanted, wanted))
    found: list[np.ndarray] = []
    every = lambda: np.column_stack([basis, *found]) if found else basis
    for k in range(wanted):
        if basis.shape[1] + len(found) == width:
            break
        v = block[:, k].copy()
        for _ in range(2):
            inner = np.array([f @ v for f in found])
            v -= sum((f * c for f, c in zip(found, inner, strict=True)), np.zeros(width))
            v -= basis @ (basis.T @ v)
            coefficient[: len(found), k] += inner
        size = np.linalg.norm(v)
        if size <= 64 * np.finfo(float).eps * scale:  # breakdown: go on from a random direction
            size = 0.0
            while True:
                v = rng.standard_normal(width)
                for _ in range(3):
                    v -= every() @ (every().T @ v)
                if np.linalg.norm(v) > 1e-6:
                    break
        coefficient[len(found), k] = size
        found.append(v / np.linalg.norm(v))
    return np.column_stack(found) if found else np.zeros((width, 0)), coefficient[: len(found)]


def leading(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int = COMPONENTS, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """The greatest eigenvalues of a symmetric, non-negative operator of which only products with blocks are known, their unit vectors as columns, and the passes made."""
    rng = np.random.default_rng(seed)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    new, passes = np.linalg.qr(rng.standard_normal((width, min(block, width))))[0], 0
    while True:
        image = product(new)
        passes += 1
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, y = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(values)[::-1][:wanted]
        vectors = basis @ y[:, top]
        residual = np.linalg.norm(images @ y[:, top] - vectors * values[top], axis=0)
        scale = max(values.max(initial=0.0), 0.0)
        if basis.shape[1] == width or (basis.shape[1] >= 2 * wanted and (residual <= TOLERANCE * scale).all()):
            break
        new, _ = _outside(image, basis, rng, max(scale, np.finfo(float).tiny))
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])  # the largest entry is positive
    return np.maximum(values[top], 0.0), vectors * turn, passes


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    spark = rows.sparkSession
    grid = written(on_grid(rows, vector), "grid")
    width = grid.agg(F.max("width").alias("w")).first().w or 0
    fit = written(grid.select("x").distinct(), "fit")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                x = _unpack(batch.column("x").slice(i, _ROWS).to_pylist(), width)
                n += len(x)
                small = int(np.abs(x.astype(np.float64)).max(initial=0)) < 2**50
                total = [a + b for a, b in zip(total, (x.sum(axis=0).tolist() if small else [sum(c) for c in zip(*x.tolist(), strict=True)]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int64()), pa.array([str(v) for v in (n, *total)])], names=["at", "value"])

    whole = fit.mapInArrow(sums_of, "at long, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    exact = {r.at: int(r.value) for r in whole.collect()}
    n, sums = exact.get(-1, 0), [exact.get(k, 0) for k in range(width)]
    mean = np.array([float(Fraction(s, n)) for s in sums]) if n else np.zeros(width)

    def centred(packed: list[bytes]) -> np.ndarray:
        return _unpack(packed, width) - mean

    def product(q: np.ndarray) -> np.ndarray:
        def partial(packed: list[bytes]) -> np.ndarray:
            c = centred(packed)
            return c.T @ (c @ q)

        return _summed(fit, partial, q.shape) / n

    def deviation_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(d for batch in batches for i in range(0, batch.num_rows, _ROWS) for d in _deviations(_unpack(batch.column("x").slice(i, _ROWS).to_pylist(), width), n, sums))
        limbs = [total >> 60 * k & (1 << 60) - 1 for k in range(max(1, -(-total.bit_length() // 60)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(limbs)), pa.int64()), pa.array(limbs, pa.int64())], names=["limb", "value"])

    kept, values, vectors, trace, error = 0, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0
    if n > 1:
        limbs = fit.select("x").mapInArrow(deviation_sum, "limb long, value long").groupBy("limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        trace = float(Fraction(sum(int(r.value) << 60 * r.limb for r in limbs), n**3))
        values, vectors, _ = leading(product, width, min(components, width))
        kept = int((values > width * np.finfo(float).eps * trace).sum())
        values, vectors = values[:kept], vectors[:, :kept]
    scaled = vectors / np.sqrt(values)
    if kept:

        def gram(packed: list[bytes]) -> np.ndarray:
            w = centred(packed) @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        both = _summed(fit, gram, (kept + 1, kept)) / n
        error = float(np.abs(both[:kept] - np.outer(both[kept], both[kept]) - np.eye(kept)).max())
    explained = values / trace if kept else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                x = _unpack(part.column("x").to_pylist(), width)
                deviation = [d if d <= _LONG else None for d in _deviations(x, n, sums)]
                at, rows_ = np.repeat(np.arange(len(x)), kept), len(x)
                cols = [
                    part.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows_)), pa.array(np.full(rows_ * kept, n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * kept, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = grid.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not kept:
        return spark.createDataFrame([], schema)
    return grid.select("vec_id", "x").mapInArrow(run, schema)


def query(embeddings: DataFrame) -> DataFrame:
    return whitened(embeddings)
