"""Centroid clustering with an annulus search.

Centroids are sorted by norm. For a vector, the distance u to the centroid whose norm is nearest to its own bounds the least distance
from above, and a centroid at distance u or less has a norm within u of the vector's. Two binary searches find those; only they are
compared, exactly, in integers. The edges of the annulus are widened by one, far more than a square root can be rounded by, so no
centroid on the boundary is lost, and of equally near ones the smallest number counts.

Each round is one pass over the vectors: tasks add up members, counts and distances of each cluster, so what is shuffled and what the
driver gets is a row of sums for each cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Integer components up to this size: squared distances then fit in 64 bits up to SIZE dimensions.
LARGEST, SIZE = 1 << 24, 4096
#: Up to this size all products and their sums are exact in float64.
SMALL = 1 << 20


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of ``dim`` components, none null or non-finite, as integers floor(scale * x)."""
    v, finite = F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("x")).filter((F.size("x") == dim) & F.forall("x", finite))
    far = F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}: squared distances would not fit in 64 bits"))
    return kept.select("vec_id", F.transform("x", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale)).otherwise(far.cast("long"))).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, by the annulus search."""
    squares = np.einsum("ij,ij->i", centroids, centroids)
    order = np.lexsort((np.arange(len(centroids)), squares))
    norms = np.sqrt(squares[order].astype(np.float64))
    own2 = np.einsum("ij,ij->i", x, x)
    own = np.sqrt(own2.astype(np.float64))
    exact = np.float64 if max(np.abs(x).max(initial=0), np.abs(centroids).max()) <= SMALL else np.int64
    left, right = x.astype(exact), centroids.astype(exact)

    def distances(rows: np.ndarray, c: int) -> np.ndarray:
        return own2[rows] - 2 * (left[rows] @ right[c]).astype(np.int64) + squares[c]

    # The centroid of nearest norm bounds the distance.
    above = np.minimum(np.searchsorted(norms, own), len(norms) - 1)
    below = np.maximum(above - 1, 0)
    first = np.where(own - norms[below] <= norms[above] - own, below, above)
    bound, number = np.empty(len(x), np.int64), order[first]
    for k in np.unique(first):
        rows = np.flatnonzero(first == k)
        bound[rows] = distances(rows, order[k])
    u = np.sqrt(bound.astype(np.float64)) + 1
    low, high = np.searchsorted(norms, own - u, "left"), np.searchsorted(norms, own + u, "right")
    best = bound.copy()
    for k, c in enumerate(order):
        rows = np.flatnonzero((low <= k) & (k < high) & (first != k))
        d = distances(rows, c)
        better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], c
    return number, best


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[np.ndarray, int]]:
    """The sum of the members of each cluster that has any, and how many they are."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            number, _ = nearest(x, centroids)
            for c in np.unique(number):
                total[c] += x[number == c].sum(axis=0)
            n += np.bincount(number, minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(met)), pa.int32()), pa.array(total[met].ravel(), pa.int64()), pa.array(np.repeat(n[met], dim), pa.int64())], ["cluster", "at", "total", "n"])

    # Sums over all tasks can pass 64 bits.
    parts = vectors.select("v").mapInArrow(run, "cluster int, at int, total long, n long").groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    found: dict[int, tuple[list, int]] = {}
    for r in parts.orderBy("cluster", "at").collect():
        found.setdefault(r.cluster, ([], r.n))[0].append(int(r.total))
    return found


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest hash of seed and id (null ids last, then by components), or all if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(F.asc_nulls_last(key), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared, to its centroid), cluster_inertia and inertia (distances summed over
    its cluster and over all), centroid_sha256. A kept vector has ``dim`` components, none null or non-finite; others have no row.

    ``rounds`` times every vector goes to its nearest centroid, and a centroid that has any takes the floor of their mean; then vectors are
    assigned once more. With fewer than ``k`` vectors each is a centroid. Rows that repeat count each and null ids are kept; no kept
    vector gives no rows. Other columns are not read. Components beyond LARGEST / scale (about 262,000) stop the run, as do ids that are no numbers.
    """
    if dim > SIZE:
        raise ValueError(f"at most {SIZE} dimensions")
    small_batches(vectors.sparkSession)
    own = whole_vectors(vectors, dim, scale, id_col, vector_col)
    centroids = start(own, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return own.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for c, (total, n) in _sums(own, centroids).items():
            centroids[c] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_matrix(batch.column(1), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    found = stored(own.mapInArrow(assign, schema), "assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each centroid
    whole = sum(r.cluster_inertia for r in sums)
    said = [(r.cluster, r.cluster_inertia, whole, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    named = own.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
