"""Whitening of embeddings by matrix-free block Lanczos.

Entries become integers, so counts, sums and deviations are exact. The covariance V of the distinct vectors is never
built: a pass over them multiplies it with a block of directions, row by row as (x - m)((x - m)'Q), and tasks return
one block each. Blocks are made orthogonal against all earlier ones, twice. Directions in which a block has nothing new
are replaced by random ones (a breakdown: the space so far is invariant, or a start missed some of it). After each pass
the small projected problem is solved on the driver; it ends when the residuals of the wanted pairs, taken from the
products themselves, are as small as rounding allows, or when the whole space is spanned.

The trace comes from the deviations of the vectors, so shares need no other eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored
from .vptree import by_dim, matrix

COMPONENTS, BLOCK = 16, 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 46)  # entries beyond it are not exact when scaled
GATHER = 16  # sums that reach the driver at once
TOLERANCE = 1e-13  # residual against the largest eigenvalue; rounding of a pass leaves less
FLAT = 1e-12  # components with less of the largest eigenvalue are rounding, not variance
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame) -> DataFrame:
    """dim, vec_id, x (longs) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fit)
    return rows.select(F.size("v").alias("dim"), "vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over the rows (x) of `part`, which takes a matrix of vectors and gives `length` numbers. `GATHER` of them meet on the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                own = part(matrix(b.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                own = np.frombuffer(x, kind)
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    kind = part(np.zeros((0, length), np.int64)).dtype
    found = rows.select("x").mapInArrow(local, "sums binary").repartition(GATHER).mapInArrow(joined, "sums binary").collect()
    return sum((np.frombuffer(r["sums"], kind) for r in found), np.zeros(1, kind))


def orthogonal(block: np.ndarray, basis: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns, also to `basis`, that span what `block` adds; where it adds nothing, random directions."""
    d, room = block.shape[0], block.shape[0] - basis.shape[1]
    out = np.zeros((d, 0))
    for k in range(min(block.shape[1], room)):
        column, size = block[:, k], least
        while True:
            start = np.linalg.norm(column)
            for _ in range(2):  # full reorthogonalisation
                for q in (basis, out):
                    column = column - q @ (q.T @ column)
            if (size := np.linalg.norm(column)) > max(least, 1e-10 * start):
                break
            column, least = rng.standard_normal(d), 0.0  # breakdown
        column = column / size
        for q in (basis, out):
            column = column - q @ (q.T @ column)
        out = np.hstack([out, (column / np.linalg.norm(column))[:, None]])
    return out


def lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(k largest eigenvalues, their unit vectors as columns, passes) of a symmetric operator on d dimensions.

    A block has k columns at least: eigenvalues that are equal k times over are all found, as a random block meets so
    many directions of each eigenspace. The driver holds a basis and its products: at most d columns each, fewer where
    it converges sooner.
    """
    rng, k = np.random.default_rng(seed), min(k, d)
    block = max(block, k)
    basis, products, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    block_ = orthogonal(rng.standard_normal((d, min(block, d))), basis, 0.0, rng)
    while True:
        new = product(block_)
        passes += 1
        basis, products = np.hstack([basis, block_]), np.hstack([products, new])
        small = basis.T @ products
        values, inside = np.linalg.eigh((small + small.T) / 2)
        values, inside = values[::-1], inside[:, ::-1]
        top = max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] >= k:
            residual = np.linalg.norm(products @ inside[:, :k] - (basis @ inside[:, :k]) * values[:k], axis=0)
            if basis.shape[1] == d or residual.max() <= tolerance * top:
                vectors = np.linalg.qr(basis @ inside[:, :k])[0]
                return values[:k], vectors, passes
        block_ = orthogonal(new, basis, 1e-13 * top, rng)


def fitted(fit: DataFrame, d: int, components: int, block: int) -> tuple[int, list[int], np.ndarray, np.ndarray, float, float]:
    """(n, sums, eigenvalues, unit vectors, trace, identity error) of the distinct vectors `fit` (x) of d dimensions."""
    # sums of upper and lower halves, so that no 64 bits overflow on any number of rows
    halves = summed(fit, lambda x: np.concatenate([(x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0), [len(x)]]).astype(np.int64), d)
    n = int(halves[-1])
    sums = [(int(a) << 24) + int(b) for a, b in zip(halves[:d], halves[d:-1], strict=True)]

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, sums).astype(np.float64) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return (c.T @ (c @ q)).ravel()

        return summed(fit, part, d).reshape(q.shape) / n

    trace = float(summed(fit, lambda x: np.array([(centred(x) ** 2).sum()]), d)[0]) / n
    if not trace:
        return n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0
    values, vectors, _ = lanczos(product, d, components, block)
    real = values > FLAT * values[0]
    values, vectors = values[real], vectors[:, real]
    own = vectors / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ own
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    k = len(values)
    total = summed(fit, spread, d) / n
    covariance = total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :])
    return n, sums, values, vectors, trace, float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: exact in 64 bits where it fits, else Python integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    far = x - whole
    if n * (int(np.abs(far).max(initial=0)) + 1) < 1 << 62:
        return n * far - rest
    return n * far.astype(object) - rest.astype(object)


def squares(own: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exact; None where it leaves 64 bits."""
    most = int(np.abs(own).max(initial=0))
    if most * most * own.shape[1] < 1 << 63:
        own = own.astype(np.int64)
        return (own * own).sum(axis=1).tolist()
    exact = (own.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row of `vectors` (vec_id, embedding).

    Rows without a vector, with null or non-finite entries, or with entries beyond 2^46 take no part. Equal vectors
    count once in the fit; each of their rows is returned, repeated rows and null vec_ids too. Vectors of different
    lengths are fitted apart. Components without variance (equal vectors, fewer vectors than dimensions) are left out,
    so a single distinct vector gives no rows, as no rows do. deviation is null where it leaves 64 bits. Equal
    eigenvalues have any unit vectors that span their space, the same for all rows. Other columns are not read.
    """
    rows = stored(integers(vectors).where("dim > 0"), "integers")
    fit = stored(rows.select("dim", "x").distinct(), "distinct")
    models = {}
    for d in sorted(r["dim"] for r in fit.select("dim").distinct().collect()):
        models[d] = fitted(fit.where(F.col("dim") == d), d, components, block)
    release(fit)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        for batch in batches:
            for d, b in by_dim(batch):
                n, sums, values, unit, trace, error = shared.value[d]
                k = len(values)
                own = deviations(matrix(b.column(2)), n, sums)
                w = (own.astype(np.float64) / n) @ unit / np.sqrt(values)
                each = lambda c: c.take(pa.array(np.repeat(np.arange(len(b)), k)))
                m = len(b) * k
                yield pa.record_batch([each(b.column(1)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(m, n)), each(pa.array(squares(own), pa.int64())), pa.array(w.ravel()), pa.array(np.tile(values / trace if k else values, len(b))), pa.array(np.full(m, error))], names=names)

    return rows.mapInArrow(run, OUT)
