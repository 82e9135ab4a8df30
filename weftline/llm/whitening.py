"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred rows. From a unit vector v_1 the bidiagonalisation alternates

    a_j u_j     = X v_j - b_(j-1) u_(j-1)
    b_j v_(j+1) = X' u_j - a_j v_j

so that X V = U B with an upper bidiagonal B of a few dozen rows, whose singular values are those of X and
whose right vectors, taken through V, are the principal components. Both products of a step come from one
pass over the rows. A left vector has an entry for each row, so it is never stored: it lies in the span of
X's columns, u_j = X c_j, and a task computes its rows' entries of all left vectors from the coefficients c.
Full reorthogonalisation needs the products U'(X v - b u), which the same pass adds up, and X'U from
earlier passes; right vectors are reorthogonalised twice where they are kept, on the driver. A pass sends
back sums only: one number per dimension and step.

A step that breaks down (a or b vanishes) goes on with a new random vector orthogonal to V, so that repeated
eigenvalues are found as often as they occur. It ends when the wanted components have converged to rounding
and the variance outside the space searched is below the last of them, or when the space is all of it.

Defined results: vectors that are null or hold null or non-finite entries are left out; shorter vectors count
as having zeros up to the longest; scaled entries beyond LIMIT in absolute value count as LIMIT; `deviation`
is exact, and null where it does not fit in 64 bits; there are as many components as the covariance has
eigenvalues above RANK times the largest, so equal rows or a single one have none; an empty table gives no
rows; repeated rows and identifiers are each kept, null ones too. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted, scratch
from .vectors import integer_vectors, matrix, stored_rows, summed

SHIFT, LIMIT = 100_000, (1 << 31) - 1 - 100_000
COMPONENTS, SEED = 8, 11
#: A coefficient below this part of X's norm is a breakdown; a residual below CONVERGED of the largest singular value is rounding.
BREAKDOWN, CONVERGED, RANK = 1e-10, 1e-15, 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"

Product = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]]


@dataclass
class Centre:
    """The number of rows and the exact sum of each dimension."""

    n: int
    sums: list[int]

    def centred(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """x - floor(mean) as longs, and x - mean as doubles; the whole part is subtracted exactly."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        whole = matrix(lists, len(self.sums), SHIFT) - floor
        return whole, whole - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, whole: np.ndarray, near: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)**2, from x - floor(mean); null beyond 64 bits."""
        rest = np.array([s % self.n for s in self.sums], object)
        about = self.n * self.n * np.einsum("ij,ij->i", near, near)
        if whole.size == 0 or about.max() < 2.0**62 and self.n * float(np.abs(whole).max() + 1) < 2.0**62:
            gap = whole * self.n - rest.astype(np.int64)
            return np.einsum("ij,ij->i", gap, gap).tolist()
        found = (sum((self.n * w - s) ** 2 for w, s in zip(row, rest, strict=True)) for row in whole.tolist())
        return [d if d < 1 << 63 else None for d in found]


def bidiagonalise(product: Product, dims: int, norm: float, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of X, the largest first.

    product(C, c) gives, for U = X C and w = X c, the sums U'w, w'w and X'w. norm: the Frobenius norm of X.
    """
    random, tiny = np.random.default_rng(seed), BREAKDOWN * norm
    right, left, images = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))  # v, c and X'u as columns
    diagonal, above = [], []

    def orthogonal(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = orthogonal(random.standard_normal(dims))
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        c = v - beta * left[:, -1] if beta else v
        right = np.column_stack([right, v])
        overlap, square, image = product(left, c)
        c, image = c - left @ overlap, image - images @ overlap
        alpha = float(np.sqrt(max(0.0, square - overlap @ overlap)))
        scale = 1 / alpha if alpha > tiny else 0.0
        left, images = np.column_stack([left, c * scale]), np.column_stack([images, image * scale])
        diagonal.append(alpha if scale else 0.0)
        b = np.diag(diagonal) + np.diag(above, 1)
        rotated, values, turned = np.linalg.svd(b)
        if right.shape[1] == dims:
            break
        rest = orthogonal(images[:, -1] - alpha * v) if scale else np.zeros(dims)
        beta = float(np.linalg.norm(rest))
        outside = norm * norm - float(values @ values)
        if len(values) >= wanted and (beta * np.abs(rotated[-1, :wanted]) <= CONVERGED * values[0]).all() and outside < values[wanted - 1] ** 2:
            break
        if beta > tiny:
            v = rest / beta
        else:
            v, beta = fresh(), 0.0
        above.append(beta)
    return values, right @ turned.T


@dataclass
class Whitening:
    """Parameters: the rows' centre, the components as columns, the eigenvalues and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def whiten(self, near: np.ndarray) -> np.ndarray:
        return near @ self.components / np.sqrt(self.eigenvalues)

    def identity_error(self, rows: DataFrame) -> float:
        """The largest absolute entry of the whitened rows' covariance minus the identity."""
        k = len(self.eigenvalues)
        if not k:
            return 0.0

        def part(batch: pa.RecordBatch) -> np.ndarray:
            w = self.whiten(self.centre.centred(batch.column(1))[1])
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        total = np.array(summed(rows, part, k + k * k)) / self.centre.n
        covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
        return float(np.abs(covariance - np.eye(k)).max())

    def transform(self, rows: DataFrame) -> DataFrame:
        """A row (RESULT) for each stored row and component."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(self.eigenvalues)
            for batch in batches:
                whole, near = self.centre.centred(batch.column(1))
                m, at = len(near), np.repeat(np.arange(len(near)), k)
                deviation = pa.array(self.centre.deviations(whole, near), pa.int64())
                columns = [
                    batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, self.centre.n)),
                    deviation.take(pa.array(at)), pa.array(self.whiten(near).ravel()), pa.array(np.tile(self.eigenvalues / self.trace, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

        return rows.mapInArrow(work, RESULT)


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = SEED, **columns) -> tuple[Whitening, DataFrame] | None:
    """The whitening fitted on all vectors of a table, and their stored rows (vec_id, x); None if there are none.

    columns: id_col, vector_col.
    """
    with scratch(vectors.sparkSession):
        kept = persisted(integer_vectors(vectors, shift=SHIFT, limit=LIMIT, **columns), "vectors")
        size = kept.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).head()
        n, dims = size["n"], size["dims"]
        if not n:
            return None
        rows = stored_rows(kept, n, 4 * dims, "whitening-rows")
    if not dims:
        return Whitening(Centre(n, []), np.zeros((0, 0)), np.zeros(0), 0.0), rows
    centre = Centre(n, summed(rows, lambda batch: matrix(batch.column(1), dims, SHIFT).sum(axis=0), dims, exact=True))

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        near = centre.centred(batch.column(1))[1]
        return np.array([np.einsum("ij,ij->", near, near)])

    def product(left: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        j = left.shape[1]

        def part(batch: pa.RecordBatch) -> np.ndarray:
            near = centre.centred(batch.column(1))[1]
            w = near @ c
            return np.concatenate([(near @ left).T @ w, [w @ w], near.T @ w])

        total = np.array(summed(rows, part, j + 1 + dims))
        return total[:j], float(total[j]), total[j + 1 :]

    square = summed(rows, spread, 1)[0]
    if not square:
        return Whitening(centre, np.zeros((dims, 0)), np.zeros(0), 0.0), rows
    values, right = bidiagonalise(product, dims, float(np.sqrt(square)), min(components, dims), seed)
    eigenvalues = values[:components] ** 2 / n
    k = int((eigenvalues > RANK * eigenvalues[0]).sum())
    return Whitening(centre, right[:, :k], eigenvalues[:k], square / n), rows


def whitened_table(vectors: DataFrame, **options) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    found = fit(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], RESULT + ", identity_error double")
    whitening, rows = found
    return whitening.transform(rows).withColumn("identity_error", F.lit(whitening.identity_error(rows)))
