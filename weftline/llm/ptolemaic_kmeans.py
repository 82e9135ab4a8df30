"""Centroid clustering over integer vectors, with Ptolemaic lower bounds from pivot distances.

The vectors are scaled to integers and stored once, with their squared distances to fixed pivots as doubles. In
each round the centroids' distances to the pivots are computed on the driver (a few dozen numbers); a task
then bounds every distance from a vector x to a centroid c from below by Ptolemy's inequality,

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)        for each pair of pivots p, s,

computes the distance to the centroid of the smallest bound exactly, and then exactly those whose bound does
not exceed the best distance so far. Bounds are rounded down by more than their floating-point error, so that
a left-out centroid is strictly farther and ties are seen: the result is that of comparing all centroids.
A round's centroid sums are added in each task first; what meets in a shuffle is one row per task and number.

Defined results: vectors that are null, hold null or non-finite entries or have another number of components
are left out; scaled components beyond LIMIT in absolute value count as LIMIT; distances beyond 64 bits are
compared exactly too, and null in the result, as are sums; a null identifier hashes as an empty one and comes out null; rows with one identifier are separate
vectors, put in the order of their components where the order of the start matters; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted, scratch
from .vectors import SCALE, integer_vectors, matrix, stored_rows, summed

LIMIT = (1 << 31) - 1
CLUSTERS, ROUNDS, DIMS, SEED, PIVOTS = 8, 10, 64, 3, 8
#: More than the relative error of any bound here, and far more than doubles of 64-bit integers lose.
MARGIN = 2.0**-46
LARGEST = np.iinfo(np.int64).max


@dataclass
class Pivots:
    """Pivot vectors and the pairs of them whose bounds are used; no pair is of equal vectors."""

    vectors: np.ndarray
    pairs: list[tuple[int, int, float]]

    @classmethod
    def of(cls, vectors: np.ndarray) -> Pivots:
        """Each pivot with the farthest of the others."""
        square = squared(vectors, vectors)
        found = {tuple(sorted((p, int(row.argmax())))) for p, row in enumerate(square) if row.max() > 0}
        return cls(vectors, [(p, s, float(np.sqrt(float(square[p, s])))) for p, s in sorted(found)])


def exact_type(x: np.ndarray, y: np.ndarray) -> type:
    """What holds all squared distances between rows: 64 bits, or Python's integers."""
    most = sum(int(np.abs(a).max()) if a.size else 0 for a in (x, y))
    return np.int64 if x.shape[1] * most**2 < LARGEST else object


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to each of the few rows of y."""
    kind = exact_type(x, y)
    out, x = np.empty((len(x), len(y)), kind), x.astype(kind)
    for j, row in enumerate(y.astype(kind)):
        gap = x - row
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def lower_bounds(to_pivots: np.ndarray, centroid_to_pivots: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Of each vector and centroid a number that the exact squared distance is not below."""
    d, e = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(centroid_to_pivots.astype(np.float64))
    bound = np.zeros((len(d), len(e)))
    for p, s, gap in pivots.pairs:
        a, b = np.outer(d[:, p], e[:, s]), np.outer(d[:, s], e[:, p])
        np.maximum(bound, (np.abs(a - b) - MARGIN * (a + b)) / gap, out=bound)
    return bound * bound * (1 - MARGIN)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (the smallest number of equally near ones), its squared distance, and how many were computed."""
    bound = lower_bounds(to_pivots, squared(centroids, pivots.vectors), pivots)
    rows, first, kind = np.arange(len(x)), bound.argmin(axis=1), exact_type(x, centroids)
    far = LARGEST if kind is np.int64 else 1 << 100
    x, centroids, exact = x.astype(kind), centroids.astype(kind), np.full(bound.shape, far, kind)
    gap = x - centroids[first]
    best = exact[rows, first] = (gap * gap).sum(axis=1)
    for j, centroid in enumerate(centroids):
        left = np.flatnonzero((bound[:, j] <= best.astype(np.float64) * (1 + MARGIN)) & (first != j))
        gap = x[left] - centroid
        exact[left, j] = (gap * gap).sum(axis=1)
        best[left] = np.minimum(best[left], exact[left, j])
    return exact.argmin(axis=1), best, (exact != far).sum(axis=1)


def first_vectors(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n vectors with the smallest SHA-256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(n).collect()
    return np.array([r["x"] for r in found], np.int64)


def with_pivots(rows: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """Adds `p`, the squared distances to the pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(matrix(batch.column(1), dims, 0), pivots.vectors).astype(np.float64)
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], ["vec_id", "x", "p"])

    return rows.mapInArrow(work, "vec_id long, x array<int>, p array<double>")


def cached(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's squared distances to the pivots."""
    return batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moved(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """One round: each non-empty centroid becomes the floor of its vectors' mean."""
    k, dims = centroids.shape

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(1), dims, 0)
        cluster, _, _ = nearest(x, cached(batch), centroids, pivots)
        sums = np.zeros((k, dims + 1), np.int64)
        for j in range(k):
            own = x[cluster == j]
            sums[j, :dims], sums[j, dims] = own.sum(axis=0), len(own)
        return sums.ravel()

    total = summed(rows, part, k * (dims + 1), exact=True)
    out = centroids.copy()
    for j in range(k):
        *sums, n = total[j * (dims + 1) : (j + 1) * (dims + 1)]
        if n:
            out[j] = [s // n for s in sums]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """(vec_id, cluster, distance, checked): the nearest centroid, and how many distances the bounds left to compute."""
    dims = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, checked = nearest(matrix(batch.column(1), dims, 0), cached(batch), centroids, pivots)
            distance = pa.array([d if d <= LARGEST else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), distance, pa.array(checked.astype(np.int32))], ["vec_id", "cluster", "distance", "checked"])

    return rows.mapInArrow(work, "vec_id long, cluster int, distance long, checked int")


@dataclass
class Clustering:
    """The stored vectors (vec_id, x, p), the centroids after the last round, and the pivots of `p`."""

    rows: DataFrame
    centroids: np.ndarray
    pivots: Pivots

    def assign(self) -> DataFrame:
        return assigned(self.rows, self.centroids, self.pivots)


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, pivots: int = PIVOTS, **columns) -> Clustering | None:
    """Clusters all vectors of a table; None if it has none. columns: id_col, vector_col."""
    with scratch(vectors.sparkSession):
        kept = persisted(integer_vectors(vectors, limit=LIMIT, dims=dims, **columns), "vectors")
        first = first_vectors(kept, max(clusters, pivots), seed)
        if not len(first):
            return None
        chosen = Pivots.of(first[:pivots])
        rows = stored_rows(with_pivots(kept, chosen, dims), kept.count(), 4 * dims + 8 * pivots, "pivot-distances")
    centroids = first[:clusters]
    for _ in range(rounds):
        before, centroids = centroids, moved(rows, centroids, chosen)
        if (before == centroids).all():  # all further rounds would give the same
            break
    return Clustering(rows, centroids, chosen)


def cluster_table(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, checked."""
    found = fit(vectors, **options)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, checked int")
    rows = persisted(found.assign(), "clusters")
    counted = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    sums = {r["cluster"]: int(r["d"]) if not r["beyond"] else LARGEST + 1 for r in counted}
    total, most = sum(sums.values()), LARGEST
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    per = [(j, d if d <= most else None, total if total <= most else None, digests[j]) for j, d in sums.items()]
    of = vectors.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """The same table, every distance computed, as DuckDB SQL over `embeddings`; without `checked`."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x AS c FROM kept QUALIFY k < {clusters})",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(d) AS d, min_by(k, [d, k]) AS k FROM (SELECT r, vec_id, x, k, {distance} AS d FROM kept, c{i}) GROUP BY r)")
        if i < rounds:
            mean = f"SELECT k, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) t(j) GROUP BY k, j"
            floors = f"SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM ({mean}) GROUP BY k"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, old.c) AS c FROM c{i} old LEFT JOIN ({floors}) m USING (k))")
    last = f"""SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (k)"""
    return "WITH " + ",\n".join(steps) + "\n" + last
