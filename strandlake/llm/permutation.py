"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, and posted in the inverted files of the first ``POSTED`` of them. There
are about as many pivots as the square root of the vectors, so a file holds about that many times ``POSTED``. A query goes to
the files of its own nearest pivots only: there it meets the vectors that share them, ranks them by the footrule distance of
the orders (the places that each pivot moves, absent ones standing just past the end), and the near ones get their cosine.
A pair meets in the first file of the query's that holds the vector, so it is looked at once.

How many files a query asks, and up to which footrule distance vectors are reranked, is measured, not fixed: a bounded sample of
the queries (``TRIALS``) is compared with every vector, and both limits are set so that their true neighbours are found with
the shares ``FILES_FIND`` and ``RANKS_FIND``. So recall holds whether the vectors are clustered (a few files do) or nearly uniform
(where many are needed).

Files are dealt in blocks of vectors and of queries, so a cluster that holds a third of all rows is many tasks. Of equal
vectors only the ones with the smallest ids can be neighbours, so a vector repeated however often is posted a few times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import text as tx
from strandlake.scratch import Scratch

#: Pivots at least and at most; they are chosen among ``SAMPLE`` times as many different usable vectors, those whose ids have the
#: smallest hashes.
LEAST, MOST, SAMPLE = 32, 4096, 4
#: Pivots that a vector is represented by, and those that it is posted under.
PREFIX, POSTED = 16, 4
#: Queries that the limits are measured with, and the shares of their true neighbours that each limit is to find.
TRIALS, FILES_FIND, RANKS_FIND = 128, 0.97, 0.985
#: Vectors and queries of a block, and pairs that are looked at together.
VECTORS, QUERIES, PAIRS = 8192, 2048, 2**19


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors that lie apart: each next one is the farthest from its nearest before, of 8 candidates in order."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    own, near, at = [0], unit @ unit[0], 1
    while len(own) < min(n, len(unit)):
        some = np.arange(at, at + 8) % len(unit)
        at += 8
        best = int(some[np.argmin(near[some])])
        if near[best] > 1 - 1e-9:  # as good as chosen already
            best = int(np.argmin(near))
            if near[best] > 1 - 1e-9:
                break
        own.append(best)
        near = np.maximum(near, unit @ unit[best])
    return unit[own]


def footrule(ranks: np.ndarray) -> np.ndarray:
    """The distance of two orders: ``ranks[..., j]`` is where the query has a vector's j-th pivot, the orders' length if nowhere.

    A pivot that only one has stands just past the end in the other; of those that only the query has, the sum is what the
    shared ones leave.
    """
    end = ranks.shape[-1]
    return end * (end + 1) // 2 + sum(_moved(ranks[..., j], j, end) for j in range(end))


def _moved(rank: np.ndarray, j: int, end: int) -> np.ndarray:
    """What a pivot in place j adds: the places it moves, less what it would add if the query alone had it."""
    return np.abs(rank - np.int16(j)) + rank - np.int16(end)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of ``a`` with rows of ``b``. A row's products are added in the same order wherever it stands, so equal
    vectors have equal scores."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def ordered(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    near = (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int16)


def placed(orders: np.ndarray, pivots: int) -> np.ndarray:
    """For each order and pivot, where the order has it; the order's length if nowhere."""
    out = np.full((len(orders), pivots), orders.shape[1], np.int16)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(orders.shape[1], dtype=np.int16)[None, :], 1)
    return out


def _stacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def nearest(ids: np.ndarray, vectors: np.ndarray, orders: np.ndarray, queries: np.ndarray, asking: np.ndarray, asked: np.ndarray, pivot: int, pivots: int, cut: int, k: int) -> list[np.ndarray]:
    """Of one file's vectors and queries: ``(query_id, vec_id, score)`` of each query's ``k`` best of the pairs that meet here first."""
    end = orders.shape[1]
    at, away = np.ascontiguousarray(placed(asked, pivots).T), end * (end + 1) // 2
    unit, posts = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True)), np.ascontiguousarray(orders.T).astype(np.intp)
    out, step = [], max(1, PAIRS // max(1, len(ids)))
    for s in range(0, len(queries), step):
        own = np.ascontiguousarray(at[:, s : s + step])
        first = own[posts[0]]
        for j in range(1, min(POSTED, end)):
            np.minimum(first, own[posts[j]], out=first)
        cosine = unit @ asking[s : s + step].T
        # the files' footrule ranks its pairs; what is farther than the cut, or met in an earlier file, isn't reranked
        near, short = np.full(first.shape, away, np.int16), np.minimum(own, np.int16(end))
        for j in range(end):
            near += _moved(short, j, end)[posts[j]]
        cosine[(near > cut) | (first != own[pivot]) | (ids[:, None] == queries[s : s + step])] = -np.inf
        cosine = np.ascontiguousarray(cosine.T)
        m = min(k, len(ids)) - 1
        least = -np.partition(-cosine, m, axis=1)[:, [m]]
        size = np.sqrt((asking[s : s + step] ** 2).sum(1, keepdims=True))
        q, x = np.nonzero((cosine >= least - 1e-9 * size) & np.isfinite(cosine))
        q += s
        score = cosines(vectors[x], asking[q])
        best = np.lexsort((ids[x], -score, q))
        best = best[np.arange(len(q)) - np.searchsorted(q[best], q[best]) < k]
        out.append((queries[q[best]], ids[x[best]], score[best]))
    return [np.concatenate([np.zeros(0, t), *(o[c] for o in out)]) for c, t in enumerate((np.int64, np.int64, np.float64))]


def _search(k: int, pivots: int, cut: int, kind: type):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        held, asked = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(held) and len(asked):
            sides = [(t.column("vec_id").to_numpy(), _stacked(t.column("vector"), kind).astype(float), _stacked(t.column("perm"), np.int16)) for t in (held, asked)]
            found = nearest(*sides[0], *sides[1], table.column("pivot")[0].as_py(), pivots, cut, k)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return run


def _exact(ids: list[int], unit: np.ndarray, k: int, kind: type):
    """The nearest of each task's vectors to the trial queries, ``k`` rows a query and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in ids]
        for b in batches:
            if not len(b):
                continue
            own, v, orders = b.column(0).to_numpy(), _stacked(b.column(1), kind).astype(float), b.column(2).to_pylist()
            near = (unit @ v.T) / np.linalg.norm(v, axis=1)
            for i, q in enumerate(ids):
                s = np.where(own == q, -np.inf, near[i])
                top = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                best[i] = sorted([*best[i], *((-float(s[j]), orders[j]) for j in top if np.isfinite(s[j]))])[:k]
        rows = [(q, s, p) for q, found in zip(ids, best, strict=True) for s, p in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.binary()))], ["q", "away", "perm"])

    return run


def _limits(whole: DataFrame, asked: DataFrame, k: int, pivots: np.ndarray, kind: type) -> tuple[int, int]:
    """How many files a query asks, and the footrule distance up to which vectors are reranked."""
    trials = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).collect()  # a bounded number of vectors
    if not trials:
        return 1, 0
    ids, vectors = [r.vec_id for r in trials], np.stack([np.frombuffer(r.vector, kind).astype(float) for r in trials])
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    found = whole.select("vec_id", "vector", "perm").mapInArrow(_exact(ids, unit, k, kind), "q long, away double, perm binary")
    best = found.withColumn("i", F.row_number().over(W.partitionBy("q").orderBy("away", "perm"))).where(F.col("i") <= k).collect()
    if not best:
        return 1, 0
    ranks = dict(zip(ids, placed(ordered(vectors, pivots, len(pivots)), len(pivots)), strict=True))
    seen = np.stack([ranks[r.q][np.frombuffer(r.perm, np.int16)] for r in best])
    files = np.sort(seen[:, :POSTED].min(1)) + 1
    far = np.sort(footrule(np.minimum(seen, seen.shape[1])))
    at = lambda share: min(len(best) - 1, math.ceil(share * len(best)) - 1)
    return int(files[at(FILES_FIND)]), int(far[at(RANKS_FIND)])


def _usable(values: list | None) -> np.ndarray | None:
    if not values or any(x is None for x in values):
        return None
    v = np.array(values, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _index(pivots: np.ndarray, kind: type):
    prefix = min(PREFIX, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, v) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (v := _usable(x)) is not None and len(v) == pivots.shape[1]]
            orders = ordered(np.stack([v for _, v in own]), pivots, prefix) if own else np.zeros((0, prefix), np.int16)
            columns = [pa.array([i for i, _ in own], pa.int64()), pa.array([v.astype(kind).tobytes() for _, v in own], pa.binary()), pa.array([p.tobytes() for p in orders], pa.binary()), pa.array(orders[:, :POSTED].astype(np.int32).tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "perm", "posted"])

    return run


def _asked(pivots: np.ndarray, files: int, kind: type):
    length = min(max(files, PREFIX), len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            orders = ordered(_stacked(b.column(1), kind).astype(float), pivots, length) if len(b) else np.zeros((0, length), np.int16)
            columns = [b.column(0), b.column(1), pa.array([p.tobytes() for p in orders], pa.binary()), pa.array(orders[:, :files].astype(np.int32).tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "perm", "posted"])

    return run


def neighbours(vectors: DataFrame, every: int, k: int = 5) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> ``(query_id, rank, vec_id, score)``: for each row whose vec_id ``every`` divides,
    the ``k`` rows found with the largest cosine, ties to the smaller vec_id; all, if there are fewer.

    Rows whose vector is null, empty, zero, of another length than most usable ones (of equally many, the longer), or has null or non-finite parts take
    no part, nor do rows with a null vec_id. A row isn't its own neighbour, nor are rows that repeat its vec_id; other repeated
    rows are neighbours each, and a repeated query is asked once, with the first of its vectors. A query that found fewer than
    ``k`` asks all files and reranks all that they hold. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    tx.small_batches(spark)
    scratch = Scratch(spark)
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    fit = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    usable = rows.where(F.forall("embedding", fit) & F.exists("embedding", lambda x: x != 0)).withColumn("size", F.size("embedding"))
    length = usable.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size, n = (length["size"], length["count"]) if length else (0, 0)
    usable = usable.where(F.col("size") == size).select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    most = min(MOST, max(LEAST, round(math.sqrt(n))))
    # one vector of each id and one id of each vector, as a repeated one would leave no room for others
    some = usable.groupBy("vec_id").agg(F.min("h").alias("h")).groupBy("h").agg(F.min(F.struct(F.xxhash64("vec_id"), "vec_id")).alias("o"))
    some = F.broadcast(some.orderBy("o").limit(SAMPLE * most))
    sample = usable.drop("vec_id").join(some, "h").groupBy("o").agg(F.min("embedding").alias("v")).orderBy("o").collect()  # SAMPLE * MOST rows at most
    pivots = choose(np.array([r.v for r in sample], np.float64), most) if sample else np.zeros((1, 0))

    index = rows.mapInArrow(_index(pivots, kind), "vec_id long, vector binary, perm binary, posted array<int>")
    # of equal vectors, those of the k + 1 smallest ids, k rows of each at most: no other can be among the k nearest of a query
    index = scratch.save(index, "index")
    same = index.groupBy("vector", "perm", "posted", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    same = same.withColumn("i", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    whole = scratch.save(same.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("i", "n"), "vectors")
    asked = index.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = scratch.save(asked, "asked")
    files, cut = _limits(whole, asked, k, pivots, kind)

    found = scratch.save(_ask(whole, asked, k, pivots, files, cut, kind, scratch), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = scratch.save(asked.join(full, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        every_file = _ask(whole, short, k, pivots, len(pivots), PREFIX * PREFIX * 2, kind, scratch)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(every_file)
    return found.select("query_id", "rank", "vec_id", "score")


def _ask(whole: DataFrame, asked: DataFrame, k: int, pivots: np.ndarray, files: int, cut: int, kind: type, scratch: Scratch) -> DataFrame:
    """The ``k`` nearest that each of ``asked`` meets in the files of its ``files`` nearest pivots."""
    held = whole.withColumn("pivot", F.explode("posted")).drop("posted")
    asking = asked.mapInArrow(_asked(pivots, files, kind), "vec_id long, vector binary, perm binary, posted array<int>")
    asking = scratch.save(asking.withColumn("pivot", F.explode("posted")).drop("posted"), "asking")
    # a row a pivot, so MOST rows at most
    cuts = held.groupBy("pivot").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("vs")).join(asking.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")), "pivot")
    cuts = F.broadcast(scratch.save(cuts, "cuts"))
    at = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.join(cuts, "pivot").select("pivot", at("vs").alias("i"), every_of("qs").alias("j"), F.lit(False).alias("asks"), "vec_id", "vector", "perm")
    right = asking.join(cuts, "pivot").select("pivot", every_of("vs").alias("i"), at("qs").alias("j"), F.lit(True).alias("asks"), "vec_id", "vector", "perm")
    found = left.unionByName(right).groupBy("pivot", "i", "j").applyInArrow(_search(k, len(pivots), cut, kind), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
