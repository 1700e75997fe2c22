"""Whitening of embeddings by contour integration (FEAST).

Vectors become integers, floor(256 c), and the covariance of the distinct ones is made in two passes over a table of them:
exact sums, then products of centred vectors, a partial matrix a partition. What comes to the driver is a matrix of the
vectors' width, whatever the number of rows. There the eigenvalues wanted are enclosed in intervals by inertia counts
(pivots of the shifted matrix, Sylvester's law). For each interval a quadrature of solves with complex shifts of the
covariance, along a circle through its ends, projects a block of vectors onto its eigenspace; Rayleigh-Ritz extracts the
eigenpairs; and the block is projected again until as many pairs as the inertia counts demand have converged, so that none
is missed. A last Rayleigh-Ritz step over all intervals makes the components orthogonal to rounding.

Rows whose vector is null or has null or non-finite entries are left out. Shorter vectors count as padded with zeros, an
empty one as all zeros. Entries beyond a long's range are held at its ends. Rows that repeat, null ids and ids that repeat
are rows of their own. Components whose eigenvalue is not above 1e-10 of the matrix's norm are left out, as nothing can be
divided by it: equal vectors, or a single one, have no component and so no rows, as has an empty table. A deviation beyond
a long is null. Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

#: Eigenvalues up to this share of the norm count as zero.
LEAST = 1e-10
#: Eigenvalues that one interval holds at most, where they can be told apart; points of the quadrature on a half circle.
MOST, POINTS = 4, 8


# eigenvalues of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the eigenvalues of ``a``, by Householder reflections."""
    a = np.array(a, np.float64)
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = math.copysign(np.linalg.norm(x), x[0])
        if size == 0:
            continue
        x[0] += size
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(reduced: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues lie above ``shift``: positive pivots of the shifted matrix, by Sylvester's law of inertia."""
    diagonal, squares = reduced
    pivot, count = 1.0, 0
    for i, x in enumerate(diagonal.tolist()):
        pivot = x - shift - (squares[i - 1] / pivot if i else 0.0)
        if pivot == 0:
            pivot = -1e-300
        count += pivot > 0
    return count


def intervals(reduced: tuple[np.ndarray, np.ndarray], low: float, high: float, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top, holding ``wanted`` at least, or all; ends are kept off the eigenvalues."""
    out: list[tuple[float, float, int]] = []
    todo, width = [(low, high)], high - low
    while todo and sum(n for _, _, n in out) < wanted:
        a, b = todo.pop()
        count = above(reduced, a) - above(reduced, b)
        if count <= MOST or b - a < 1e-9 * width:
            out += [(a, b, count)] if count else []
            continue
        step = (b - a) / 256
        cuts = [(a + b) / 2 + step * s * (-1) ** s for s in range(100)]
        cut = next((c for c in cuts if above(reduced, c - step) == above(reduced, c + step)), cuts[0])
        todo += [(a, cut), (cut, b)]
    return out


def project(a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """``block`` projected onto the eigenvectors with eigenvalues between ``low`` and ``high``: Gauss-Legendre quadrature of
    solves with complex shifts along the circle through them, half of which is the other half's conjugate."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for x, w in zip(*np.polynomial.legendre.leggauss(POINTS), strict=True):
        turn = np.exp(1j * math.pi * (1 - x) / 2)
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, block.astype(complex))
        out += w / 2 * (radius * turn * solved).real
    return out


def ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values, falling, and unit vectors of ``a`` on the space that ``block`` spans."""
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    basis = left[:, sizes > sizes[0] * 1e-14]
    inner = basis.T @ a @ basis
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], (basis @ vectors)[:, ::-1]


def inside(a: np.ndarray, low: float, high: float, count: int, norm: float, rounds: int = 40) -> np.ndarray:
    """The eigenvectors of the ``count`` eigenvalues between ``low`` and ``high``."""
    d = len(a)
    block = np.random.default_rng(20240501).standard_normal((d, min(d, 2 * count + 4)))
    close, best, vectors = 16 * math.sqrt(d) * np.finfo(float).eps * norm, math.inf, None
    for _ in range(rounds):
        values, block = ritz(a, project(a, block, low, high))
        rest = np.linalg.norm(a @ block - block * values, axis=0)
        within = np.flatnonzero((values > low) & (values <= high))
        within = within[np.argsort(rest[within], kind="stable")][:count]
        if len(within) == count and rest[within].max() < best:
            best, vectors = rest[within].max(), block[:, within]
        if best <= close:
            break
    if best > 1e-10 * norm:
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but they were not all found")
    return vectors


def feast(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    norm = float(np.abs(a).sum(0).max()) if a.size else 0.0  # bounds all eigenvalues
    if not norm:
        return np.zeros(0), np.zeros((len(a), 0))
    a = (a + a.T) / 2
    parts = [inside(a, low, high, count, norm) for low, high, count in intervals(tridiagonal(a), LEAST * norm, 1.01 * norm, wanted)]
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    values, vectors = ritz(a, np.concatenate(parts, 1))
    return values[:wanted], vectors[:, :wanted]


# tables


def integers(df: DataFrame, vector: str, id_column: str) -> DataFrame:
    """i (the id) and x (array of longs) of the rows whose vector is whole."""
    whole = df.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return whole.where(F.col("v").isNotNull() & ~bad).select("i", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _exact_sum(x: np.ndarray) -> list[int]:
    safe = not x.size or int(np.abs(x.astype(np.float64)).max()) < (1 << 61) // max(1, len(x))
    return [int(s) for s in (x if safe else x.astype(object)).sum(0)] if len(x) else [0] * x.shape[1]


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension: a row a dimension and partition is shuffled, a row a dimension collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, sums = 0, [0] * width
        for batch in batches:
            many += batch.num_rows
            sums = [a + b for a, b in zip(sums, _exact_sum(_matrix(batch.column("x"), width)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([many] * width, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], ["d", "n", "s"]
        )

    rows = fit.select("x").mapInArrow(run, "d int, n long, s decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    found = {r.d: r for r in rows}
    return found[0].n, [int(found[d].s) for d in range(width)]


def summed(df: DataFrame, column: str, shape: tuple[int, int], fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``fn`` (an array of ``shape``) over slices of a column of vectors: partial sums a partition, rows of which
    are shuffled and summed, and only ``shape`` comes to the driver."""
    wide = shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += fn(_matrix(batch.column(0), len(batch.column(0).flatten()) // batch.num_rows if batch.num_rows else wide))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, wide), pa.int32()), pa.array(total.ravel()))], ["d", "v"])

    parts = df.select(column).mapInArrow(run, "d int, v array<double>")
    out = np.zeros(shape)
    for r in parts.groupBy("d").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect():
        out[r.d] = r.v
    return out


@dataclass
class Whitening:
    """What a fit gives: rows and exact sums of the distinct vectors, and the components as rows, each with its eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None beyond a long."""
        largest = self.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if self.width * largest**2 < 1 << 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(e) if e < 1 << 63 else None for e in exact]


def fit_whitening(vectors: DataFrame, most: int = 4) -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors`` (x, of one width or shorter); None without any."""
    spark = vectors.sparkSession
    small_batches(spark)
    width = vectors.agg(F.max(F.size("x")).alias("w")).first().w
    if not width:
        return None
    scratch = Scratch(spark)
    try:
        fit = scratch.written(padded(vectors, width).select("x").distinct())
        n, sums = totals(fit, width)
        mean = np.array([s / n for s in sums])

        def products(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ centred

        covariance = summed(fit, "x", (width, width), products) / n
        values, vectors_ = feast(covariance, most)
        found = Whitening(n, sums, values, vectors_.T, float(np.trace(covariance)))
        if len(values):
            found.identity_error = identity_error(fit, found)
        return found
    finally:
        scratch.clear()


def padded(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.withColumn("x", F.concat("x", F.expr(f"array_repeat(0L, {width} - size(x))")))


def identity_error(fit: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    k = len(found.values)
    mean = summed(fit, "x", (1, k), lambda x: found.whitened(x).sum(0)[None])[0] / found.n

    def products(x: np.ndarray) -> np.ndarray:
        centred = found.whitened(x) - mean
        return centred.T @ centred

    return float(np.abs(summed(fit, "x", (k, k), products) / found.n - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", most: int = 4) -> DataFrame:
    """The id, component (from 1), n, deviation, whitened, explained, identity_error of each whole row and component."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = integers(df, vector, id_column)
    found = fit_whitening(vectors, most)
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], schema)
    k, explained = len(found.values), found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch.column("x"), found.width), batch.num_rows
            columns = [
                batch.column("i").take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array([found.n] * (n * k), pa.int64()),
                pa.array(found.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(found.whitened(x).ravel()),
                pa.array(np.tile(explained, n)), pa.array([found.identity_error] * (n * k)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return padded(vectors, found.width).mapInArrow(run, schema)


def op11_embedding_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
