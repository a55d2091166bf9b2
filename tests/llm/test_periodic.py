import random

import numpy as np

from strandlake.llm import periodic
from tests.llm.common import awkward, documents, prose


def brute(w, least):
    """Every maximal run of every period, by comparing words; of equal stretches the smallest period stays."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def numpy_runs(words, least):
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return [tuple(map(int, r)) for r in zip(*periodic.runs_of_words(x, np.zeros(len(x), np.int64), least))] if len(x) else []


def test_random_sequences_against_brute_force():
    r = random.Random(1)
    for trial in range(1500):
        w = [r.randrange(r.choice((1, 2, 2, 3, 5))) for _ in range(r.randrange(1, 60))]
        least = r.choice((2, 3, 4, 6, 12))
        assert numpy_runs(w, least) == brute(w, least), (w, least)


def test_structured_sequences_against_brute_force():
    r = random.Random(2)
    fib = [[0], [0, 1]]
    while len(fib) < 13:
        fib.append(fib[-1] + fib[-2])
    cases = [fib[-1], [0] * 300, list(range(40)) * 7, ([0, 1] * 30 + [2]) * 4]
    for _ in range(60):  # repeats in repeats, with a copy elsewhere
        a = [r.randrange(40) for _ in range(r.randrange(1, 15))]
        b = a * r.randrange(2, 5) + [r.randrange(40) for _ in range(r.randrange(4))]
        c = b * r.randrange(1, 4)
        cases.append([r.randrange(40) for _ in range(20)] + c + [99] + c[: r.randrange(len(c) + 1)] + [r.randrange(40) for _ in range(20)])
    for w in cases:
        assert numpy_runs(w, 12) == brute(w, 12)
        assert numpy_runs(w, 2) == brute(w, 2)


def test_sequences_side_by_side(monkeypatch):
    r = random.Random(3)
    texts = [[r.randrange(4) for _ in range(r.randrange(0, 80))] for _ in range(200)]
    x, of = np.array([v for t in texts for v in t]), np.repeat(np.arange(200), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    want = [(int(first[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in brute(t, 6)]
    for together in (2**18, 64):
        monkeypatch.setattr(periodic, "TOGETHER", together)
        assert [tuple(map(int, c)) for c in zip(*periodic.runs_of_words(x, of, 6))] == want


def test_the_vocabulary_of_squares_is_whole():
    """All primitively rooted squares are reached from the leftmost-covering set."""
    r = random.Random(4)
    for _ in range(200):
        x = np.array([r.randrange(3) for _ in range(40)] + [-1])
        squares = {(i, k) for i in range(40) for k in range(1, 21) if i + 2 * k <= 40 and (x[i : i + k] == x[i + k : i + 2 * k]).all()}
        words = {tuple(x[i : i + 2 * k]) for i, k in squares if not any(k % d == 0 and (x[i : i + k - d] == x[i + d : i + k]).all() for d in range(1, k))}
        got = {tuple(x[i : i + 2 * k]) for s, n, k in zip(*periodic._runs_of(x)) for i in range(s, s + n - 2 * k + 1)}
        assert got == words


def test_texts(spark):
    r = random.Random(5)
    rows = awkward()
    rows += [(100 + i, " \n".join([prose(40, i)] + [prose(7, 50 + i)] * r.randrange(2, 6) + [prose(30, 90 + i)])) for i in range(10)]
    rows += [(200, prose(900, 7) + "\n" + (prose(3000, 9) + "\t") * 4), (201, "a " * 50_000), (202, "no no no no no no no no no no no"), (203, "No no " * 6)]
    got = sorted(map(tuple, periodic.runs(documents(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        runs = [(0, 50_000, 1)] if i == 201 else brute(w, 12) if len(w) < 20_000 else []
        want.append((i, len(w), [(s, n, q) for s, n, q in runs], collapsed(w, runs)))
    assert [(i, n, [tuple(x) for x in runs], c) for i, n, runs, c in got] == sorted(want, key=str)
    assert periodic.runs(documents(spark, [])).collect() == []
