"""Runs of periodic words: stretches that repeat with a smallest period at least twice, after Gusfield and Stoye.

A run of length L and period q has L - q >= L / 2 places where a word equals the one q places on. So with ``least`` words at least, each
of its words lies in a window of half as many words that occurs elsewhere in the run. Windows that occur twice in a text are found by
their hashes; the stretches that they cover hold every run whole, most texts have none, and only these stretches go further. (A hash met by
chance only adds a stretch.) In them the method runs in numpy, over many stretches side by side, each with words of its own:

1. Suffix array and ranks of all substrings of 2^k words, by doubling. The suffix tree is the array with its longest common prefixes: a node or
   a place on an edge is an interval of ranks and a depth, and the suffix link of the place of x[i:j] is the place of x[i+1:j], about rank[i+1].
   The ranks of two substrings compared from the longest down give the longest common extension of any two places, forward and backward.
2. Lempel-Ziv blocks. The leftmost occurrence of a square w w ends the block it lies in, so it is seen from a block's border by two extensions
   for each period: one pass for squares that begin in the block whose border they cross, one for those that begin before it.
   These squares are a leftmost-covering set: any square's first occurrence is reached from one of them by moves of one word to the right.
3. Suffix-link walks from the covering squares with a primitive root: a link drops the first word and the walk goes on while the next word is that one. The
   places passed, each counted once, are the whole vocabulary of squares.
4. The interval of a square's place lists all its occurrences. Occurrences of one period at successive words are one run, which is maximal, and as
   the roots are primitive its period is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text as tx

#: Words of stretches that are searched together (one longer stretch is searched alone), at about 250 bytes each.
TOGETHER = 2**18
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Minima:
    """Minima of all stretches of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            m = self.levels[-1]
            self.levels.append(np.minimum(m[:-step], m[step:]))
            step *= 2

    def reach(self, at: np.ndarray, bound: np.ndarray, to: int) -> np.ndarray:
        """How many values from ``at`` on, to the right (``to`` 1) or to the left (-1), are ``bound`` at least."""
        out = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            m = self.levels[k]
            i = at + out if to > 0 else at - out - (1 << k) + 1
            inside = (i >= 0) & (i < len(m))
            out += (inside & (m[np.where(inside, i, 0)] >= bound)).astype(np.int64) << k
        return out


class _Index:
    """Suffix array, ranks of substrings and longest common prefixes of ``x``, whose last value occurs once."""

    def __init__(self, x: np.ndarray):
        names = np.unique(x, return_inverse=True)[1].astype(np.int64)
        self.names, n, step = [names.astype(np.int32)], len(x), 1
        while names.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - step] = names[step:] + 1
            names = np.unique(names * (n + 1) + after, return_inverse=True)[1]
            self.names.append(names.astype(np.int32))
            step *= 2
        self.rank = names
        self.order = np.empty(n, np.int64)
        self.order[names] = np.arange(n)
        # common[r]: how far the suffixes of ranks r - 1 and r agree
        self.common = np.concatenate(([0], self.forward(self.order[:-1], self.order[1:])))
        self.prefixes = _Minima(self.common)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values agree from ``i`` and from ``j`` on (i != j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            m, a, b = self.names[k], i + out, j + out
            inside = (a < len(m)) & (b < len(m))
            out += (inside & (m[np.where(inside, a, 0)] == m[np.where(inside, b, 0)])).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values agree before ``i`` and before ``j`` (i != j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            m, a, b = self.names[k], i - out - (1 << k), j - out - (1 << k)
            inside = (a >= 0) & (b >= 0)
            out += (inside & (m[np.where(inside, a, 0)] == m[np.where(inside, b, 0)])).astype(np.int64) << k
        return out

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks begin, and the end: a block is the longest stretch that also begins earlier, or one new value."""
        first, r = _Minima(self.order), np.arange(len(self.order))
        longest = np.zeros(len(r), np.int64)
        for to in (-1, 1):
            # the nearest rank on either side whose suffix begins earlier
            other = r + to * (1 + first.reach(r + to, self.order, to))
            some = (other >= 0) & (other < len(r))
            found = self.forward(self.order[other[some]], self.order[some])
            np.maximum.at(longest, self.order[some], found)
        jump, at = (np.arange(len(r)) + np.maximum(longest, 1)).tolist(), [0]
        while at[-1] < len(jump):
            at.append(jump[at[-1]])
        return np.array(at)

    def place(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of ranks, both ends in, of the suffixes that begin as x[i : i + depth]."""
        r = self.rank[i]
        return r - self.prefixes.reach(r, depth, -1), r + self.prefixes.reach(r + 1, depth, 1)


def _each(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the values first[i], first[i] + 1, ... (n[i] of them), and the i's."""
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(of)), of


def _covering(t: _Index) -> tuple[np.ndarray, np.ndarray]:
    """Squares (start, period) from which every square's leftmost occurrence is reached by moves to the right."""
    b = t.blocks()
    h, h1 = b[:-1], b[1:]
    size, n = h1 - h, len(t.order)
    after = np.concatenate((size[1:], [0]))
    x, out = t.names[0], []

    # begun in the block: the border h1 lies in the second half
    k, of = _each(np.ones(len(h), np.int64), np.where(h1 < n, size, 0))
    q, e = h1[of] - k, h1[of]
    hit = x[q] == x[e]
    k, q, e = k[hit], q[hit], e[hit]
    fwd, back = t.forward(e, q), t.backward(e, q)
    ok = fwd + back >= k
    out.append((np.maximum(q - back, q - k + 1)[ok], k[ok]))

    # begun before the block: its start h lies in the first half, which ends in the block
    k, of = _each(np.ones(len(h), np.int64), np.minimum(np.where(h > 0, size + after, 0), n - 1 - h))
    q, e = h[of] + k, h[of]
    hit = (x[q] == x[e]) & (x[q - 1] == x[e - 1])
    k, q, e, end = k[hit], q[hit], e[hit], h1[of][hit]
    fwd, back = t.forward(e, q), t.backward(e, q)
    start = np.maximum(e - back, e - k + 1)
    ok = (fwd + back >= k) & (start + k <= end)
    out.append((start[ok], k[ok]))
    return np.concatenate([s for s, _ in out]), np.concatenate([k for _, k in out])


def _primitive(t: _Index, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the squares' halves are no powers: no k / prime is a period too."""
    if not len(k):
        return np.zeros(0, bool)
    least = np.arange(int(k.max()) + 1)  # the smallest prime factor
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            many = least[p * p :: p]
            many[many == np.arange(p * p, len(least), p)] = p
    out, rest = np.ones(len(k), bool), k.copy()
    while (todo := np.flatnonzero(out & (rest > 1))).size:
        p = least[rest[todo]]
        d = k[todo] // p
        out[todo] = t.forward(start[todo], start[todo] + d) < 2 * k[todo] - d
        rest[todo] //= p
    return out


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal repetition of ``x``, whose last value occurs once."""
    t = _Index(x)
    start, k = _covering(t)
    ok = _primitive(t, start, k)
    start, k = start[ok], k[ok]
    # the stretch that has the square's period; squares of one stretch need one walk
    start = start - t.backward(start, start + k)
    start, k = np.unique(np.stack([start, k]), axis=1) if len(k) else (start, k)
    squares = t.forward(start, start + k) - k + 1
    # walks: as many links as there are squares, at most once around; each place of the tree once
    i, of = _each(start, np.minimum(k, squares))
    k = k[of]
    lo, hi = t.place(i, 2 * k)
    _, one = np.unique(np.stack([lo, k]), axis=1, return_index=True) if len(k) else (None, np.zeros(0, np.int64))
    r, of = _each(lo[one], (hi - lo + 1)[one])
    at, k = t.order[r], k[one][of]
    by = np.lexsort((at, k))
    at, k = at[by], k[by]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1 if len(first) else first
    return at[first], at[last] - at[first] + 2 * k[first], k[first]


def _stretches(x: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from, to) of the stretches of ``x`` that windows of ``width`` values cover which occur twice among those of equal ``of``.

    ``of`` doesn't fall. Stretches that lose their repeats as they are told apart go, until nothing changes.
    """
    lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(x))
    while len(at) >= width:
        v, o = x[at], of[at]
        h = np.zeros(len(v) - width + 1, np.uint64)
        for j in range(width):
            h = tx.mix(h * np.uint64(0x9E3779B97F4A7C15) + v[j : j + len(h)].astype(np.uint64) + np.uint64(1))
        h = tx.mix(h + o[: len(h)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        whole = np.flatnonzero(o[: len(h)] == o[width - 1 :])
        order = whole[np.argsort(h[whole], kind="stable")]
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] = same
        twice[:-1] |= same
        covered = np.zeros(len(v) + 1, np.int64)
        np.add.at(covered, order[twice], 1)
        np.add.at(covered, order[twice] + width, -1)
        keep = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        begins = np.ones(len(keep), bool)
        begins[1:] = (keep[1:] != keep[:-1] + 1) | (o[keep[1:]] != o[keep[:-1]])
        done = len(keep) == len(at)
        at = at[keep]
        first = np.flatnonzero(begins)
        lo, hi = at[first], at[np.concatenate((first[1:], [len(at)])) - 1] + 1 if len(first) else at[first]
        if done:
            break
        of = np.zeros(len(x), np.int64)
        of[at] = np.cumsum(begins)
    else:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return lo, hi


def runs_of_words(x: np.ndarray, of: np.ndarray, least: int) -> list[np.ndarray]:
    """Runs (start, length, period), by start, then period, of the sequences that lie end to end in ``x``; ``of`` numbers them in order."""
    lo, hi = _stretches(x, of, (least + 1) // 2)
    out, begin = [], 0
    while begin < len(lo):
        end = begin + max(1, int(np.searchsorted(np.cumsum(hi[begin:] - lo[begin:]), TOGETHER, "right")))
        n = hi[begin:end] - lo[begin:end]
        at, own = _each(lo[begin:end], n)
        # each stretch has values of its own, and one that occurs once after it
        v = np.zeros(len(at) + len(n), np.int64)
        where = np.arange(len(at)) + own
        v[where] = own * (int(x.max()) + 1) + x[at]
        v[np.cumsum(n) + np.arange(len(n))] = -1 - np.arange(len(n))
        s, length, k = _runs_of(v)
        back = np.zeros(len(v), np.int64)
        back[where] = at
        out.append(np.stack([back[s], length, k]))
        begin = end
    found = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
    found = found[:, found[1] >= least]
    return list(found[:, np.lexsort((found[2], found[0]))])


def _search(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or b"").split() for t in tx.binaries(b.column(1))]
            n = np.array([len(w) for w in texts], np.int64)
            ends = np.cumsum(n)
            number: dict[bytes, int] = {}
            x = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(n.sum()))
            of = np.repeat(np.arange(len(n)), n)
            start, length, period = runs_of_words(x, of, least) if len(x) else [np.zeros(0, np.int64)] * 3
            own = np.searchsorted(ends, start, "right")
            start = start - (ends - n)[own]
            cuts = np.searchsorted(own, np.arange(len(n) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
            kept = []
            for i, words in enumerate(texts):
                mine = slice(cuts[i], cuts[i + 1])
                if mine.start < mine.stop:
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, start[mine] + period[mine], 1)
                    np.add.at(drop, start[mine] + length[mine], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(cuts), spans), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, runs array<struct<start,length,period>>, collapsed)``, a row for each row.

    A run is a stretch of words (what no white space of ASCII divides, case kept) with smallest period q and ``max(least, 2 q)`` words
    or more that can't be longer with that period. They come by start, then period; runs of different periods may overlap and all are there. ``collapsed`` is the
    text's words without those that a run holds after its first q, joined by single spaces.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Texts are searched whole, however long; what repeats in one takes
    about 250 bytes a word while it is. Rows are searched one by one, so repeated rows and null ids need nothing. An empty table gives an
    empty result. Other columns aren't looked at.
    """
    tx.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_search(least), f"doc_id long, n_words long, runs {RUN}, collapsed string")
