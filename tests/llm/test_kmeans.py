import hashlib
import math

import numpy as np
import pytest

from strandlake.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, x int, e int, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7, 7, 7) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and None not in v and np.isfinite(v).all():
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    hashed = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    c = [x for _, x in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(kept, own) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    total = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, o, d, total[o], sum(total.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in out), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(5, 12)) * 2
    rows = [(i, (centre[i % 5] + rng.normal(size=12)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 12) for i in range(200)] + [(7, [0.25] * 12)] * 3  # a hot vector, and repeated rows
    for k, rounds in ((8, 10), (3, 2), (1, 1), (8, 0)):
        assert rows_of(kmeans.clusters(table(spark, rows), k, rounds, size=12)) == brute(rows, k, rounds, 12)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(6)] + [(10, [0.5, 0.0])]
    assert rows_of(kmeans.clusters(table(spark, rows), 8, 3, size=2)) == brute(rows, 8, 3, 2)
    x = np.array([[0, 0], [4, 0], [2, 0]])
    assert kmeans.nearest(x, np.array([[4, 0], [0, 0], [0, 0]]), np.array([0, 1]))[0].tolist() == [1, 0, 0]


def test_awkward_rows(spark):
    good = [0.5, -0.25]
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("-inf"), 0.0]), (7, good), (None, good), (None, [3.0, 3.0]), (8, [0.0, -0.0])]
    assert rows_of(kmeans.clusters(table(spark, rows), 2, 4, size=2)) == brute(rows, 2, 4, 2)
    for none in ([], rows[:6]):
        got = kmeans.clusters(table(spark, none), 8, 10, size=2)
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        kmeans.clusters(table(spark, [(1, [1e30, 0.0])]), size=2).collect()


def test_centroids_are_abandoned_early():
    rng = np.random.default_rng(1)
    c = rng.integers(-5000, 5000, (8, 64))
    x = c[rng.integers(0, 8, 500)] + rng.integers(-200, 200, (500, 64))
    own, best, looked = kmeans.nearest(x, c, np.argsort(-x.var(0)))
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
    assert looked < 0.5 * x.size * len(c)
