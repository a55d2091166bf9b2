"""Centroid clustering of vectors in whole numbers: Lloyd's rounds with a partial-distance search.

A vector's components are scaled and floored, so distances, sums and means are exact and the result doesn't depend on how rows
are dealt. The nearest centroid is sought dimension by dimension, those with the largest variance over all vectors first: squared
differences are added up, and a centroid is dropped for a vector as soon as its partial distance is strictly above the best whole
one so far, which begins with that of the nearest by the first dimensions. What is left at the last dimension has its whole distance;
ties go to the smaller number.

A round is one scan of the scaled vectors: each task adds up its own vectors by cluster, and only these sums (clusters x dimensions
rows a task) are shuffled. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.scratch import Scratch

#: Dimensions that are added between two looks at which centroids are still in the race.
STEP = 8
#: Scaled components up to here keep a squared distance of 64 of them under 2^63.
LARGEST = 2**27
_FAR = np.iinfo(np.int64).max


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of ``x``, its squared distance, and how many differences that took."""
    x, c = np.ascontiguousarray(x[:, order]), centroids[:, order]
    size, looked = x.shape[1], 0

    def go_on(at: np.ndarray, far: np.ndarray, k: np.ndarray | int, best: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Add the dimensions after the first ``STEP``; those strictly above ``best`` leave."""
        nonlocal looked
        for s in range(STEP, size, STEP):
            d = x[at, s : s + STEP] - c[k, s : s + STEP]
            looked += d.size
            far = far + np.einsum("ij,ij->i", d, d)
            if best is not None:
                stays = far <= best[at]
                at, far = at[stays], far[stays]
        return at, far

    head = np.stack([np.square(x[:, :STEP] - y).sum(1) for y in c[:, :STEP]], 1) if len(x) else np.zeros((0, len(c)), np.int64)
    looked += head.size * min(STEP, size)
    # the nearest by the first dimensions sets the bound that the others are held against
    guess = head.argmin(1)
    own = guess.astype(np.int32)
    best = go_on(np.arange(len(x)), head[np.arange(len(x)), guess], guess, None)[1]
    for k in range(len(c)):
        at = np.flatnonzero((guess != k) & (head[:, k] <= best))
        at, far = go_on(at, head[at, k], k, best)
        closer = (far < best[at]) | ((far == best[at]) & (k < own[at]))
        best[at[closer]], own[at[closer]] = far[closer], k
    return own, best, looked


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _spread(size: int):
    """Count, sum and sum of squares of each dimension, a row each, for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(size), np.zeros(size)
        for b in batches:
            x = _matrix(b.column(0), size).astype(float)
            n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(s), pa.array(ss)], ["dim", "n", "s", "ss"])

    return run


def _sums(centroids: np.ndarray, order: np.ndarray):
    """Count and sums of each cluster's vectors, for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        n, s = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            x = _matrix(b.column(0), size)
            own = nearest(x, centroids, order)[0]
            n += np.bincount(own, minlength=k)
            for c in np.unique(own):
                s[c] += x[own == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(s[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return run


def _assigned(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, best, _ = nearest(_matrix(b.column(1), centroids.shape[1]), centroids, order)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own), pa.array(best)], ["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, a row for
    each row that is kept.

    Kept are rows with exactly ``size`` components, none null or non-finite; a component x counts as floor(scale * x). The ``k`` rows with
    the smallest SHA-256 of ``seed:vec_id`` start as centroids 0, 1, ...; of repeated ids the smaller vector comes first, rows with a null id
    come last. If fewer are kept there are fewer centroids. Each round assigns every row to its nearest centroid (ties: the smaller number)
    and moves each centroid that has rows to the floor of their mean; ones without rows stay. Then rows are assigned once more.

    Repeated rows count as often as they are there. An empty table, or one with no such row, gives an empty result. Other columns aren't looked
    at. Components beyond 2^27 after scaling, and inertias beyond a long, are errors, as the result couldn't hold the distances.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    row = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    row = row.where((F.size("e") == size) & ~bad).withColumn("x", F.transform("e", lambda c: F.floor(c * scale)))
    large = F.exists("x", lambda c: (c > LARGEST) | (c < -LARGEST))
    row = row.select("vec_id", F.when(large, F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).otherwise(F.col("x")).alias("x"))
    kept = scratch.save(row, "vectors")

    parts = kept.select("x").mapInArrow(_spread(size), "dim int, n long, s double, ss double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    variance = {r.dim: r.ss / r.n - (r.s / r.n) ** 2 for r in parts if r.n}  # `size` rows
    order = np.array(sorted(range(size), key=lambda d: (-variance.get(d, 0.0), d)))
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(F.asc_nulls_last(first), "x").limit(k).collect()  # k rows
    centroids = np.array([r.x for r in start], np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        sums = kept.select("x").mapInArrow(_sums(centroids, order), "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("dim", "s"))
        # exact: a task's sums are longs, those of all tasks decimals; k * size rows come back
        for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            centroids[r.cluster, r.dim] = Fraction(int(r.s), r.n).__floor__()

    out = scratch.save(kept.mapInArrow(_assigned(centroids, order), "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    if sum(inertia.values()) > _FAR:
        raise OverflowError("the inertia doesn't fit a long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    own = [inertia.get(c, 0) for c in range(len(centroids))]
    return out.select("vec_id", "cluster", "distance", of(own, "long").alias("cluster_inertia"), F.lit(sum(own)).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))
