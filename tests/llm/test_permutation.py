import numpy as np

from strandlake.llm import permutation

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, b int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7.0, 7, 7) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            s = sorted((-float((x * y).sum() / (np.sqrt((y * y).sum()) * np.sqrt((x * x).sum()))), i) for i, y in good if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 24))
    rows = [(i, (centre[i % 30] + rng.normal(size=24)).tolist()) for i in range(6000)]
    rows += [(6000 + i, (centre[0] + 1e-4 * rng.normal(size=24)).tolist()) for i in range(2000)]
    got = permutation.neighbours(table(spark, rows), 50).collect()
    want = brute(rows, 50, 5)
    assert {r.query_id for r in got} == set(want)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * sum(map(len, want.values()))
    vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for r in got[::17]:
        a, b = vec[r.query_id], vec[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(700 + i, [-1.0, 0.5, float(i)]) for i in range(50)]
    got = [r for r in permutation.neighbours(table(spark, rows), 50).collect() if r.query_id == 100]
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_awkward_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (0, [1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in permutation.neighbours(table(spark, rows), 50).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0), (50, 3, 0)]
    assert permutation.neighbours(table(spark, []), 50).collect() == []
    assert permutation.neighbours(table(spark, [(1, None)]), 50).collect() == []


def test_pivots_lie_apart():
    rng = np.random.default_rng(1)
    sample = np.concatenate([np.tile(rng.normal(size=8), (1500, 1)), rng.normal(size=(300, 8))])
    assert len(permutation.choose(sample, 256)) == 256


def test_footrule_is_the_sum_of_moves():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, q = rng.permutation(30)[:8], rng.permutation(30)[:8]
        at = lambda order, p: list(order).index(p) if p in order else len(order)
        want = sum(abs(at(x, p) - at(q, p)) for p in set(x) | set(q))
        seen = permutation.placed(q[None, :].astype(np.int16), 30)[0][x]
        assert permutation.footrule(seen) == want


def test_recall_on_the_drivers_vectors(spark):
    """Nearly uniform vectors, the hardest case: many files are asked, and no fewer than 0.9 of the true neighbours found."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, 50, 5)
    got = permutation.neighbours(table(spark, rows), 50).collect()
    assert len(got) == sum(map(len, want.values()))
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)


def test_a_file_asked_by_few_finds_what_it_holds(spark):
    """Far outliers share no file with their neighbours among the trials; they still get as many as there are."""
    rng = np.random.default_rng(3)
    rows = [(i + 1, (np.eye(16)[0] + 0.01 * rng.normal(size=16)).tolist()) for i in range(400)]
    rows += [(5000 + 50 * i, (-np.eye(16)[i % 16]).tolist()) for i in range(6)]
    got = permutation.neighbours(table(spark, rows), 50).collect()
    assert all(sum(r.query_id == q for r in got) == 5 for q in {r.query_id for r in got})
    assert len({r.query_id for r in got}) == 8 + 6


def test_unusable_and_repeated_rows_take_no_pivots(spark):
    """60 vectors among 40,000 that take no part, and beside 3,000 rows of one id or of one vector: the same neighbours."""
    rng = np.random.default_rng(5)
    real = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    found = lambda rows: sorted(map(tuple, permutation.neighbours(table(spark, rows), 50).collect()))
    alone = found(real)
    assert len(alone) == 10
    zero = [(100 + i, [0.0] * 8 if i % 2 else [0.0] * 7 + [float("nan")]) for i in range(40_000)]
    assert found(real + zero) == alone
    short = [(100 + i, [1.0] * 3) for i in range(59)]
    assert found(real + short) == alone
    far = (-np.array(real[0][1]) - np.array(real[50][1])).tolist()
    got = found(real + [(7001, far)] * 3000)
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in alone]
