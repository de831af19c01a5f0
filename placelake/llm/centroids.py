"""Centroid clustering with block-norm screening.

A vector is cut into segments. The norms of a vector's segments are its compressed form, worked out
once; those of the centroids once a round. By Cauchy and Schwarz the dot product of two segments is at
most the product of their norms, so that the sum of ``(norm of x - norm of c)**2`` over the segments is
a lower bound on the squared distance. Centroids are met in the order of their bounds, and only those
whose bound doesn't exceed the best distance so far get an exact distance, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.shared import write_table

SCALE = 1024
SEGMENTS = 16
LARGEST = 1 << 27
"""Components beyond this are not kept: with 64 of them, a squared distance would not fit a long."""
STEP_ROWS = 1 << 14
"""Vectors that one vectorised step handles at once."""


def kept_vectors(vectors: DataFrame, dims: int, scale: int, column: str) -> DataFrame:
    """``vec_id`` and ``v``, the integers ``floor(scale * x)``, of vectors with ``dims`` finite components."""
    x = F.col(column)
    good = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < LARGEST / scale))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("int")).alias("v"))


def norms(v: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each segment; the last ones may be shorter by one component."""
    out = np.empty((len(v), segments))
    for s, cut in enumerate(np.array_split(np.arange(v.shape[1]), segments)):
        part = v[:, cut].astype(np.float64)
        out[:, s] = np.sqrt(np.einsum("ij,ij->i", part, part))
    return out


def nearest(v: np.ndarray, compressed: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, of equal ones the first, its squared distance, and how many exact distances that took."""
    own = norms(centroids, segments)
    bound = np.zeros((len(v), len(centroids)))
    for s in range(segments):
        bound += (compressed[:, s, None] - own[None, :, s]) ** 2
    # rounding never makes a bound exceed what it bounds
    bound = bound * (1 - 1e-9) - 1e-6 * (1 + compressed.max(axis=1, initial=0)[:, None])
    order = np.argsort(bound, axis=1, kind="stable")
    best, number, taken = np.full(len(v), np.iinfo(np.int64).max), np.full(len(v), len(centroids)), 0
    rows = np.arange(len(v))
    for turn in range(len(centroids)):
        c = order[rows, turn]
        open_ = bound[rows, c] <= best[rows]
        rows, c = rows[open_], c[open_]  # later bounds are no smaller, so that a row that stops is done
        if not len(rows):
            break
        taken += len(rows)
        gap = v[rows] - centroids[c]
        distance = np.einsum("ij,ij->i", gap, gap)
        better = (distance < best[rows]) | ((distance == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = distance[better], c[better]
    return number, best, taken


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _compress(dims: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = norms(_matrix(batch.column("v"), dims), segments)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * segments), pa.array(kept.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "norms"])

    return run


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, segments: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    for whole in batches:
        for at in range(0, whole.num_rows, STEP_ROWS):
            batch = whole.slice(at, STEP_ROWS)
            v = _matrix(batch.column("v"), centroids.shape[1]).astype(np.int64)
            yield batch, v, *nearest(v, _matrix(batch.column("norms"), segments), centroids, segments)


def _sums(centroids: np.ndarray, segments: int):
    """A row per centroid and component with the sum over its vectors, for each task; component -1 counts them, -2 the exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count, exact = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for _, v, number, _, taken in _assigned(batches, centroids, segments):
            exact += taken
            count += np.bincount(number, minlength=k)
            for c in range(k):
                total[c] += v[number == c].sum(axis=0)
        rows = np.concatenate([total.ravel(), count, [exact]])
        where = np.concatenate([np.repeat(np.arange(k), dims), np.arange(k), [0]]), np.concatenate([np.tile(np.arange(dims), k), np.full(k, -1), [-2]])
        yield pa.RecordBatch.from_arrays([pa.array(where[0], pa.int32()), pa.array(where[1], pa.int32()), pa.array(rows, pa.int64())], ["cluster", "component", "total"])

    return run


def _final(centroids: np.ndarray, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, number, distance, _ in _assigned(batches, centroids, segments):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = SCALE, segments: int = SEGMENTS, salt: str = "3:", column: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """Cluster vectors by ``rounds`` rounds of nearest centroids, in integers.

    ``vectors`` needs vec_id and the array ``column``. Kept are vectors of ``dims`` components, none of
    them null, infinite, NaN or of more than LARGEST in integers. Centroids start as the ``k`` kept
    vectors of the smallest SHA-256 of ``salt`` and vec_id (null: nothing after ``salt``), equal ones in
    the order of their components; fewer kept vectors give fewer centroids, and none gives no rows. Of
    equal distances the smaller number wins; a centroid without vectors stays. Repeated rows count each.

    Returns the rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), the final
    centroids, and how many exact distances each round took. What comes to the driver are sums by
    centroid and component. An inertia that no long holds is null.
    """
    table = kept_vectors(vectors, dims, scale, column)
    table = write_table(table.mapInArrow(_compress(dims, segments), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>, norms array<double>"), "vectors")
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = table.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # at most k rows
    centroids, exact = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), dims), []
    for _ in range(rounds if seeds else 0):
        sums = table.mapInArrow(_sums(centroids, segments), "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum("total").alias("total"))
        total = {(r.cluster, r.component): r.total for r in sums.collect()}  # k * (dims + 1) + 1 rows
        exact.append(total[0, -2])
        centroids = np.array([[total[c, d] // n for d in range(dims)] if (n := total[c, -1]) else centroids[c].tolist() for c in range(len(seeds))], np.int64)
    final = [[int(x) for x in c] for c in centroids]
    if not seeds:
        centroids = np.zeros((1, dims), np.int64)
    rows = write_table(table.mapInArrow(_final(centroids, segments), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.inertia) for r in rows.groupBy("cluster").agg(wide.alias("inertia")).collect()}  # at most k rows
    fits = lambda n: n if n < 1 << 63 else None
    known = [(c, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, final[c])).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    facts = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), final, exact
