"""Assemblies as edits against the reference, and what can be answered through them.

``ops(asm_id, block_ix, op_ix, kind, dst, len, src, lit)`` tile each block: kind 0 a literal run, 1 a copy of the reference,
3 one of its other strand (src is the lowest reference position); 2, a copy within the block, is written by ``chains.own_copies``.
``runs(asm_id, contig_ix, a, len, ref_lo, dir)`` are maximal spans of a contig that are one span of the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators import joins, kmers
from strandlake.operators.cohort import SIZES, Cohort
from strandlake.scratch import Scratch

SEED, WINDOW, CANDIDATES, MIN_COPY = 24, 8, 32, 20
_NONE = np.uint64(2**63)  # over every hash
#: Diagonals of a block that one pass tries at most; passes go on until none is left.
PASS = 1024
#: Bases of a reference that goes to every worker, and how many of its seeds, of 12 bytes each.
LOCAL, LOCAL_SEEDS = 2**27, 2**24
#: Bases of blocks whose minimizers are found together.
TOGETHER = 2**18
#: Zeros at the reference's ends: a block's bases at most.
PAD = max(SIZES)
#: Hits in the reference that go to every task.
PLACED = 1_000_000
OPS = "asm_id int, block_ix long, op_ix int, kind int, dst int, len int, src long, lit binary"
TURNED = 2**40  # added to diagonals of the other strand, to sort them after the rest
_COMP = np.arange(256, dtype=np.uint8)
_COMP[[65, 67, 71, 84]] = [84, 71, 67, 65]


def minimizers(seq: bytes, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, place, turned)`` of the k-mers of SEED bases that are least by hash among WINDOW neighbouring ones; of equal ones all.

    A k-mer and its reverse complement have one hash; ``turned`` says which of them is there, 2 that they are the same. Two sequences that agree
    in WINDOW + SEED - 1 bases, on either strand, have such a k-mer of them in common. ``own``: only windows that begin before it.
    """
    return _minimizers(seq, np.zeros(1, np.int64), np.array([len(seq)]), own)[:3]


def _least(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """``f`` over each ``w`` values side by side, by doubling."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _minimizers(seq: bytes, first: np.ndarray, size: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that begin at ``first`` in ``seq``, with an N between them; also of which sequence each is. Places are within it."""
    c, ok = kmers.codes(seq, SEED)
    r = kmers.rc_codes(c, SEED)
    low = np.minimum(c, r)
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h = np.where(ok, (h ^ (h >> np.uint64(29))) >> np.uint64(1), _NONE)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)
    # a sequence with fewer k-mers than a window has is one window
    short = (size >= SEED) & (size < SEED + WINDOW - 1)
    for lo, k in zip(first[short].tolist(), (size[short] - SEED + 1).tolist(), strict=True):
        chosen[lo : lo + k] = h[lo : lo + k] == h[lo : lo + k].min()
    if n >= WINDOW:
        least = _least(h, WINDOW, np.minimum)
        # windows that don't lie in a sequence choose nothing
        edge = np.zeros(len(least) + 1, np.int64)
        lo, k = first[size >= SEED + WINDOW - 1], size[size >= SEED + WINDOW - 1] - (SEED + WINDOW - 2)
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + (k if own is None else np.minimum(k, own)), -1)
        # the largest of the minima of a place's windows is its own value where one of them chose it
        padded = np.zeros(n + WINDOW - 1, np.uint64)
        padded[WINDOW - 1 : WINDOW - 1 + len(least)] = np.where(np.cumsum(edge[:-1]) > 0, least, np.uint64(0))
        chosen |= _least(padded, WINDOW, np.maximum) == h
    at = np.flatnonzero(chosen & ok)
    of = np.searchsorted(first, at, "right") - 1
    return h[at], at - first[of], np.where(c[at] == r[at], 2, (c[at] > r[at]).astype(np.int64)), of


def _minimizers_of(seqs: list[bytes]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """``_minimizers`` of many sequences, some at once, with the number of the first of them."""
    ends = np.cumsum([len(x) + 1 for x in seqs])
    lo = 0
    while lo < len(seqs):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
        size = np.array([len(x) for x in seqs[lo:hi]])
        yield lo, _minimizers(b"N".join(seqs[lo:hi]), np.concatenate(([0], np.cumsum(size + 1)[:-1])), size)
        lo = hi


def _seeds(tables: DataFrame, keys: str, own: int | None):
    """``(*keys, place, h, turned)`` of the sequences in the last column of ``tables``."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [minimizers(x, own) for x in b.column(len(names)).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            h, at, turned = (np.concatenate([np.zeros(0, t), *(f[i] for f in found)]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(len(names))), pa.array(at), pa.array(h.astype(np.int64)), pa.array(turned.astype(np.int32))], [*names, "place", "h", "turned"])

    return tables.mapInArrow(run, f"{keys}, place long, h long, turned int")


def reference_seeds(reference: Cohort) -> DataFrame:
    """``(h, rpos, turned)``: the minimizers of the reference's contigs, by their places in the stream, each once."""
    c = reference.contigs.select("asm_id", "contig_ix", "boff")
    rows = _seeds(reference.chunks.select("asm_id", "contig_ix", "cstart", "seq"), "asm_id int, contig_ix int, cstart long", reference.q)
    rows = rows.join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"])
    return rows.select("h", (F.col("boff") + F.col("cstart") + F.col("place")).alias("rpos"), "turned").distinct()


def _runs_of_true(x: np.ndarray) -> np.ndarray:
    """How many true values begin at each place."""
    ends = np.where(~x, np.arange(len(x)), len(x))
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(x))


class _Cover:
    """A block, the longest match at each of its places among the diagonals tried so far, and the seeds that name diagonals.

    ``turn`` and ``diag`` are the block's diagonals, sorted; hit i is a seed at ``at[i]`` on diagonal ``of[i]``.
    """

    def __init__(self, seq: bytes, turn: np.ndarray, diag: np.ndarray, of: np.ndarray, at: np.ndarray, state: bytes | None = None):
        n = len(seq)
        self.seq, self.x, self.turn, self.diag, self.of, self.at = seq, np.frombuffer(seq, np.uint8), turn, diag, of, at
        if state is None:
            state = bytes(4 + 17 * n + len(turn))
        cut = np.cumsum([4, 8 * n, 8 * n, n])
        parts = [state[lo:hi] for lo, hi in zip([0, *cut], [*cut, len(state)], strict=True)]
        self.passes, self.best, self.best_diag, self.best_turn, self.tried = (np.frombuffer(p, t).copy() for p, t in zip(parts, (np.int32, np.int64, np.int64, np.int8, bool), strict=True))

    def state(self) -> bytes:
        return b"".join(a.tobytes() for a in (self.passes, self.best, self.best_diag, self.best_turn, self.tried))

    def copies(self) -> list[tuple[int, int]]:
        """Greedy: at the first place that has one, the longest match, if it is long enough; then on from its end."""
        out, o, places = [], 0, np.flatnonzero(self.best >= MIN_COPY)
        while (k := int(np.searchsorted(places, o))) < len(places):
            at = int(places[k])
            out.append((at, int(self.best[at])))
            o = at + out[-1][1]
        return out

    def pick(self) -> np.ndarray:
        """The next diagonals: of those not tried with seeds that touch literal bases, the ones with the most such seeds."""
        if not len(self.of):
            return self.of
        literal = np.ones(len(self.seq), np.int64)
        for at, size in self.copies():
            literal[at : at + size] = 0
        before = np.concatenate(([0], np.cumsum(literal)))
        untried = ~self.tried[self.of] & (before[self.at + SEED] > before[self.at])
        n = np.bincount(self.of[untried], minlength=len(self.turn))
        best = np.argsort(-n, kind="stable")[: min(CANDIDATES << min(int(self.passes[0]), 16), PASS)]
        best = np.sort(best[n[best] > 0])
        self.passes += 1
        self.tried[best] = True
        return best

    def extend(self, turn: int, diag: int, skip: int, ref: bytes) -> None:
        r = np.frombuffer(ref, np.uint8)
        y = np.zeros(len(self.x), np.uint8)  # the reference under the block, 0 where it ends
        y[skip : skip + len(r)] = _COMP[r[::-1]] if turn else r
        got = _runs_of_true(self.x == y)
        better = got > self.best
        self.best[better], self.best_diag[better], self.best_turn[better] = got[better], diag, turn

    def extend_all(self, best: np.ndarray, ref: np.ndarray) -> None:
        """``extend`` by many diagonals, with the whole reference at hand and PAD zeros at both its ends."""
        n = len(self.x)
        turn, diag = self.turn[best].astype(bool), self.diag[best]
        at = np.where(turn, diag - n + 1, diag) + PAD
        under = np.lib.stride_tricks.as_strided(ref, (len(ref) - n + 1, n), (1, 1), writeable=False)
        here = np.arange(n, dtype=np.int16)
        for k in range(0, len(best), 64):
            y, back = under[at[k : k + 64]], turn[k : k + 64]
            if back.any():
                y[back] = _COMP[y[back][:, ::-1]]
            ends = np.where(y == self.x, np.int16(n), here)
            got = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - here
            most = got.max(0)
            better = most > self.best
            which = (got[:, better] == most[better]).argmax(0) + k
            self.best[better], self.best_diag[better], self.best_turn[better] = most[better], diag[which], turn[which]

    def ops(self) -> list[tuple]:
        o, out = 0, []
        for at, size in self.copies():
            if at > o:
                out.append((0, o, at - o, 0, self.seq[o:at]))
            d = int(self.best_diag[at])
            # forward: reference = diag + offset; other strand: reference = diag - offset, lowest at the copy's end
            out.append((3, at, size, d - at - size + 1, None) if self.best_turn[at] else (1, at, size, d + at, None))
            o = at + size
        if o < len(self.seq):
            out.append((0, o, len(self.seq) - o, 0, self.seq[o:]))
        return out


def _ops_batch(covers: Iterator[tuple[int, int, _Cover]]) -> pa.RecordBatch:
    out = [(asm, block, i, *op) for asm, block, cover in covers for i, op in enumerate(cover.ops())]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    names = ["asm_id", "block_ix", "op_ix", "kind", "dst", "len", "src", "lit"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def align(cohort: Cohort, reference: Cohort) -> DataFrame:
    """``ops`` for every block: diagonals from minimizers that the reference has too, then a greedy cover.

    A block tries its 32 diagonals with the most seeds, then, pass by pass, twice as many (up to PASS at once) of those with the
    most seeds that touch what is still literal, until no such seed has a diagonal untried. A seed has the first 32 of its places
    in the reference, as there.

    A reference of up to LOCAL bases and LOCAL_SEEDS seeds, which are checked, goes to every worker, and blocks are aligned where they are read, without
    a shuffle. A larger one is joined by seed. Both ways give the same ops.
    """
    total = reference.contigs.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    seeds = stored_seeds(reference)
    few = total <= LOCAL and seeds.count() <= LOCAL_SEEDS
    rows = _hinted_locally(cohort, reference, seeds, total) if few else _hinted_by_join(cohort, reference, seeds, total)
    return Scratch(cohort.spark).save(rows, "ops")


def stored_seeds(reference: Cohort) -> DataFrame:
    """``(h, rpos, facing)``: of each seed the first CANDIDATES places."""
    first = F.row_number().over(W.partitionBy("h").orderBy("rpos"))
    seeds = reference_seeds(reference).withColumn("i", first).where(F.col("i") <= CANDIDATES)
    return Scratch(reference.spark).save(seeds.select("h", "rpos", F.col("turned").alias("facing")), "seeds")


def _hinted_locally(cohort: Cohort, reference: Cohort, seeds: DataFrame, total: int) -> DataFrame:
    spark = cohort.spark
    seq = np.zeros(total + 2 * PAD, np.uint8)
    for r in reference.blocks.select("bstart", "seq").toLocalIterator():
        seq[PAD + r.bstart : PAD + r.bstart + len(r.seq)] = np.frombuffer(r.seq, np.uint8)
    # place and facing in one number; sorted by both keys, as places of a seed are taken in order
    table = seeds.select("h", (F.col("rpos") * 4 + F.col("facing")).cast("int").alias("p")).toArrow()
    known, places = table.column("h").to_numpy().view(np.uint64), table.column("p").to_numpy()
    del table
    order = np.lexsort((places, known))
    known, places = known[order], places[order]
    del order
    shared = spark.sparkContext.broadcast((seq, known, places))
    del seq, known, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, known, places = shared.value

        def covers(seqs: list[bytes]) -> Iterator[_Cover]:
            for lo, (h, where, turned, block) in _minimizers_of(seqs):
                first = np.searchsorted(known, h, "left")
                met = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                first = first[met]
                n = np.searchsorted(known, h[met], "right") - first
                own = np.repeat(met, n)
                p = places[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(own))].astype(np.int64)
                o, p, facing, mine, block = where[own], p >> 2, p & 3, turned[own], block[own]
                even, odd = (mine == 2) | (facing == mine), (mine == 2) | (facing != mine)
                # the block, then the diagonal, of either strand: both fit a number
                key = np.concatenate([(p - o)[even], (TURNED + p + (SEED - 1) + o)[odd]])
                block, at = (np.concatenate([v[even], v[odd]]) for v in (block, o))
                near = np.argsort(block, kind="stable")
                key, at, block = key[near], at[near], block[near]
                yield lo, key, at, np.searchsorted(block, np.arange(int(block[-1]) + 2)) if len(block) else np.zeros(1, np.int64)

        def covered(x: bytes, key: np.ndarray, at: np.ndarray) -> _Cover:
            keys, of = np.unique(key, return_inverse=True)
            turn = (keys >= TURNED // 2).astype(np.int64)
            cover = _Cover(x, turn, keys - TURNED * turn, of, at)
            while len(best := cover.pick()):
                cover.extend_all(best, ref)
            return cover

        def all_of(seqs: list[bytes]) -> Iterator[_Cover]:
            none, done = np.zeros(0, np.int64), 0
            for lo, key, at, edges in covers(seqs):
                for x in seqs[done:lo]:
                    yield covered(x, none, none)
                for k in range(len(edges) - 1):
                    yield covered(seqs[lo + k], key[edges[k] : edges[k + 1]], at[edges[k] : edges[k + 1]])
                done = lo + len(edges) - 1
            for x in seqs[done:]:
                yield covered(x, none, none)

        for b in batches:
            asm, block, seq = (b.column(i).to_pylist() for i in range(3))
            yield _ops_batch(zip(asm, block, all_of(seq), strict=True))

    return cohort.blocks.select("asm_id", "block_ix", "seq").mapInArrow(run, OPS)


def _hinted_by_join(cohort: Cohort, reference: Cohort, seeds: DataFrame, total: int) -> DataFrame:
    scratch = Scratch(cohort.spark)
    mine = _seeds(cohort.blocks.select("asm_id", "block_ix", "seq"), "asm_id int, block_ix long", None)
    both = scratch.save(mine.join(seeds, "h").select("asm_id", "block_ix", F.col("place").cast("int").alias("o"), "rpos", "turned", "facing"), "met")
    fwd = both.where("turned = 2 or facing = turned").select("asm_id", "block_ix", "o", F.lit(0).alias("dir"), (F.col("rpos") - F.col("o")).alias("diag"))
    back = both.where("turned = 2 or facing <> turned").select("asm_id", "block_ix", "o", F.lit(1).alias("dir"), (F.col("rpos") + (SEED - 1) + F.col("o")).alias("diag"))
    hits = fwd.union(back).groupBy("asm_id", "block_ix", "dir", "diag").agg(F.collect_list("o").alias("at"))
    hits = hits.groupBy("asm_id", "block_ix").agg(F.array_sort(F.collect_list(F.struct("dir", "diag", "at"))).alias("hits"))
    todo = cohort.blocks.select("asm_id", "block_ix", "seq").join(hits, ["asm_id", "block_ix"], "left")
    todo = scratch.save(todo.select("*", F.lit(None).cast("binary").alias("state"), F.lit(None).cast(_HINTS).alias("hints")).mapInArrow(_one_pass, _TODO), "pass")
    done = todo.where("size(picked) = 0")
    while not (todo := todo.where("size(picked) > 0")).isEmpty():
        at = todo.select("asm_id", "block_ix", F.length("seq").alias("blen"), F.explode("picked").alias("p")).select("asm_id", "block_ix", "blen", "p.dir", "p.diag")
        lo = F.when(F.col("dir") == 0, F.col("diag")).otherwise(F.col("diag") - F.col("blen") + 1)
        hi = lo + F.col("blen")
        at = at.withColumn("start", F.greatest(lo, F.lit(0))).withColumn("end", F.least(hi, F.lit(total)))
        skip = F.when(F.col("dir") == 0, F.col("start") - lo).otherwise(hi - F.col("end")).cast("int")
        at = at.withColumn("skip", skip).where("start < end")
        spans = at.select(F.struct("asm_id", "block_ix", "dir", "diag", "skip").alias("id"), F.lit(0).alias("asm_id"), "start", (F.col("end") - F.col("start")).alias("length"), F.lit(False).alias("rc"))
        refs = reference.windows(spans, case=False).select("id.*", F.col("seq").cast("binary").alias("ref"))
        own = refs.groupBy("asm_id", "block_ix").agg(F.array_sort(F.collect_list(F.struct("dir", "diag", "skip", "ref"))).alias("hints"))
        todo = scratch.save(todo.drop("picked").join(own, ["asm_id", "block_ix"], "left").mapInArrow(_one_pass, _TODO), "pass")
        done = done.union(todo.where("size(picked) = 0"))
    return done.mapInArrow(_finished, OPS)


_HINTS = "array<struct<dir:int,diag:bigint,skip:int,ref:binary>>"
_HITS = "array<struct<dir:int,diag:bigint,at:array<int>>>"
_TODO = f"asm_id int, block_ix long, seq binary, hits {_HITS}, state binary, picked array<struct<dir:int,diag:bigint>>"


def _covers(b: pa.RecordBatch) -> Iterator[tuple[int, int, _Cover]]:
    """Of rows that begin with ``asm_id, block_ix, seq, hits, state``."""
    for asm, block, seq, hits, state in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
        turn, diag = (np.array([h[k] for h in hits or ()], np.int64) for k in ("dir", "diag"))
        of = np.repeat(np.arange(len(turn)), [len(h["at"]) for h in hits or ()]).astype(np.int64)
        yield asm, block, _Cover(seq, turn, diag, of, np.array([o for h in hits or () for o in h["at"]], np.int64), state)


def _one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the reference under the diagonals picked before, and pick the next ones; none are left where ``picked`` is empty."""
    for b in batches:
        states, picked = [], []
        for (_, _, cover), hints in zip(_covers(b), b.column(5).to_pylist(), strict=True):
            for h in hints or ():
                cover.extend(h["dir"], h["diag"], h["skip"], h["ref"])
            best = cover.pick()
            picked.append([{"dir": d, "diag": g} for d, g in zip(cover.turn[best].tolist(), cover.diag[best].tolist(), strict=True)])
            states.append(cover.state())
        kind = pa.list_(pa.struct([("dir", pa.int32()), ("diag", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(states, pa.binary()), pa.array(picked, kind)], ["asm_id", "block_ix", "seq", "hits", "state", "picked"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _ops_batch(_covers(b))


def execute(ops: DataFrame, reference: Cohort) -> DataFrame:
    """``(asm_id, block_ix, seq)``: the blocks that ``ops`` without copies within a block stand for."""
    copies = ops.where("kind in (1, 3)").select(F.struct("asm_id", "block_ix", "op_ix").alias("id"), F.lit(0).alias("asm_id"), F.col("src").alias("start"), F.col("len").cast("long").alias("length"), (F.col("kind") == 3).alias("rc"))
    parts = reference.windows(copies, case=False).select("id.asm_id", "id.block_ix", "id.op_ix", "seq")
    parts = parts.union(ops.where("kind = 0").select("asm_id", "block_ix", "op_ix", F.col("lit").cast("string")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_ix", "seq"))), lambda s: s["seq"]), "")
    return parts.groupBy("asm_id", "block_ix").agg(joined.alias("seq"))


def runs(cohort: Cohort, ops: DataFrame) -> DataFrame:
    """Maximal spans: copies cut at contig ends, then neighbours that go on in the reference in the same direction are one."""
    spans = ops.where("kind in (1, 3)").select("asm_id", (F.col("block_ix") * cohort.q + F.col("dst")).alias("lo"), (F.col("block_ix") * cohort.q + F.col("dst") + F.col("len")).alias("hi"), "src", (F.col("kind") == 3).cast("int").alias("dir"))
    contigs = cohort.contigs.select("asm_id", "contig_ix", F.col("boff").alias("rlo"), (F.col("boff") + F.col("len")).alias("rhi"))
    cut = joins.overlap_join(spans, contigs, ["asm_id"], cohort.q)
    x0, x1 = F.greatest("lo", "rlo"), F.least("hi", "rhi")
    ref = F.when(F.col("dir") == 0, F.col("src") + (x0 - F.col("lo"))).otherwise(F.col("src") + (F.col("hi") - x1))
    cut = cut.select("asm_id", "contig_ix", (x0 - F.col("rlo")).alias("a"), (x1 - x0).alias("len"), ref.alias("ref_lo"), "dir")
    by = W.partitionBy("asm_id", "contig_ix").orderBy("a")
    was = {c: F.lag(c).over(by) for c in ("a", "len", "ref_lo", "dir")}
    follows = (was["a"] + was["len"] == F.col("a")) & (was["dir"] == F.col("dir"))
    follows &= F.when(F.col("dir") == 0, was["ref_lo"] + was["len"] == F.col("ref_lo")).otherwise(F.col("ref_lo") + F.col("len") == was["ref_lo"])
    cut = cut.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("long"))
    cut = cut.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    out = cut.groupBy("asm_id", "contig_ix", "run", "dir").agg(F.min("a").alias("a"), F.sum("len").alias("len"), F.min("ref_lo").alias("ref_lo"))
    return out.select("asm_id", "contig_ix", "a", "len", "ref_lo", "dir")


def residual(cohort: Cohort, spans: DataFrame, k: int) -> DataFrame:
    """``(asm_id, contig_ix, lo, hi)``: starts of windows of k bases that lie in no run, as intervals."""
    covered = spans.where(F.col("len") >= k).select("asm_id", "contig_ix", F.col("a").alias("lo"), (F.col("a") + F.col("len") - k + 1).alias("hi"))
    ends = cohort.contigs.where(F.col("len") >= k).select("asm_id", "contig_ix", (F.col("len") - k + 1).alias("lo"), (F.col("len") - k + 1).alias("hi"))
    by = W.partitionBy("asm_id", "contig_ix").orderBy("lo", "hi")
    rows = covered.union(ends).withColumn("since", F.coalesce(F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.where("since < lo").select("asm_id", "contig_ix", F.col("since").alias("lo"), F.col("lo").alias("hi"))


def residual_chunks(cohort: Cohort, gaps: DataFrame) -> DataFrame:
    """Chunks of the windows in ``gaps`` alone: each gap cut at chunk ends, with the bases that its windows need."""
    cut = gaps.withColumn("cstart", joins.bins(F.col("lo"), F.col("hi"), cohort.q)).withColumn("cstart", F.col("cstart") * cohort.q)
    both = cut.join(cohort.chunks, ["asm_id", "contig_ix", "cstart"])
    x0, x1 = F.greatest("lo", "cstart"), F.least(F.col("hi"), F.col("cstart") + cohort.q)
    part = F.substring("seq", (x0 - F.col("cstart") + 1).cast("int"), (x1 - x0 + (kmers.K - 1)).cast("int"))
    return both.select("asm_id", "contig_ix", x0.alias("cstart"), part.alias("seq"))


def transfer(hits: DataFrame, spans: DataFrame, reference: Cohort, k: int, flip: bool = True, reverse: bool = True) -> DataFrame:
    """Hits in the reference carried to every run that holds them: each is found once and copied, not searched again.

    Up to PLACED hits, which is checked, go to every task in order of their places, and each run takes its slice of them where it is read; more are
    joined to runs by bins of their places. ``flip`` and ``reverse`` are there for negative controls: without the one, hits on reversed runs
    keep the reference's strand; without the other they are dropped.
    """
    c = reference.contigs.select("contig_ix", "boff")
    points = hits.drop("asm_id").join(joins.broadcast_if_small(c), "contig_ix").withColumn("pos", F.col("boff") + F.col("pos")).drop("boff", "contig_ix")
    rest = [x for x in hits.columns if x not in ("asm_id", "contig_ix", "pos", "strand")]
    points = points.select("pos", "strand", *rest)
    few = points.limit(PLACED + 1).toArrow()
    if len(few) <= PLACED:
        return _transfer_few(few.sort_by([(n, "ascending") for n in few.column_names]), spans, k, flip, reverse, hits)
    held = spans.where(F.col("len") >= k).withColumn("lo", F.col("ref_lo")).withColumn("hi", F.col("ref_lo") + F.col("len") - k + 1)
    both = joins.point_join(points, held, [], 4 * reference.q)
    if not reverse:
        both = both.where("dir = 0")
    at = F.when(F.col("dir") == 0, F.col("a") + F.col("pos") - F.col("ref_lo")).otherwise(F.col("a") + F.col("ref_lo") + F.col("len") - k - F.col("pos"))
    strand = F.col("strand").bitwiseXOR(F.col("dir")) if flip else F.col("strand")
    return both.select("asm_id", "contig_ix", at.alias("pos"), *rest, strand.alias("strand")).select(*hits.columns)


def _transfer_few(points: pa.Table, spans: DataFrame, k: int, flip: bool, reverse: bool, hits: DataFrame) -> DataFrame:
    names, where = hits.columns, points.column("pos").to_numpy()
    shared = hits.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value.combine_chunks()
        where = points.column("pos").to_numpy()
        for b in batches:
            asm, contig, a, n, ref, turned = (b.column(i).to_numpy() for i in range(6))
            lo, hi = np.searchsorted(where, ref, "left"), np.searchsorted(where, ref + n - k, "right")
            size = np.maximum(hi - lo, 0)
            own = np.repeat(np.arange(len(n)), size)
            which = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(len(own))
            got = points.take(pa.array(which))
            off = where[which] - ref[own]
            at = np.where(turned[own] == 0, a[own] + off, a[own] + n[own] - k - off)
            strand = got.column("strand").to_numpy()
            columns = {"asm_id": pa.array(asm[own]), "contig_ix": pa.array(contig[own]), "pos": pa.array(at), "strand": pa.array((strand ^ turned[own]) if flip else strand, pa.int32())}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else got.column(c).combine_chunks() for c in names], names)

    if not len(where):
        return hits.where("false")
    # runs that no hit can stand on are left out by their places before they reach a worker
    held = spans.where((F.col("len") >= k) & (F.col("ref_lo") <= int(where[-1])) & (F.col("ref_lo") + F.col("len") - k >= int(where[0])))
    if not reverse:
        held = held.where("dir = 0")
    return held.select("asm_id", "contig_ix", F.col("a").cast("long"), F.col("len").cast("long"), F.col("ref_lo").cast("long"), F.col("dir").cast("int")).mapInArrow(run, hits.schema)


def search_by_transfer(cohort: Cohort, reference: Cohort, spans: DataFrame, patterns: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """The hits of a full scan, with ``origin``: carried from the reference, or found in the windows that no run holds.

    ``gaps`` are those windows' bases (``residual_chunks``), if they are stored; else they are cut out here.
    """
    gaps = residual_chunks(cohort, residual(cohort, spans, kmers.K)) if gaps is None else gaps
    carried = transfer(kmers.search(reference, patterns), spans, reference, kmers.K).withColumn("origin", F.lit("transfer"))
    found = kmers.search(cohort, patterns, gaps).withColumn("origin", F.lit("residual"))
    return carried.unionByName(found)


def sites_by_transfer(cohort: Cohort, reference: Cohort, spans: DataFrame, guides: DataFrame, most: int, gaps: DataFrame | None = None) -> DataFrame:
    gaps = residual_chunks(cohort, residual(cohort, spans, kmers.K)) if gaps is None else gaps
    carried = transfer(kmers.guide_sites(reference, guides, most), spans, reference, kmers.K).withColumn("origin", F.lit("transfer"))
    found = kmers.guide_sites(cohort, guides, most, gaps).withColumn("origin", F.lit("residual"))
    return carried.unionByName(found)


def stored_gaps(cohort: Cohort, spans: DataFrame, k: int = kmers.K) -> DataFrame:
    """The bases of the windows that no run holds, stored once for a cohort and its runs: all that a search by transfer reads of it."""
    return Scratch(cohort.spark).save(residual_chunks(cohort, residual(cohort, spans, k)), "gaps")


def origin_split(hits: DataFrame, key: str) -> DataFrame:
    """For each pattern or guide: hits in all, carried, residual, the residual share, and the assemblies that have residual ones."""
    gone = F.col("origin") == "residual"
    out = hits.groupBy(key).agg(F.count("*").alias("total"), F.count_if(~gone).alias("transfer"), F.count_if(gone).alias("residual"), F.countDistinct(F.when(gone, F.col("asm_id"))).alias("assemblies_with_residual"))
    return out.withColumn("residual_frac", F.col("residual") / F.col("total"))


def contexts(cohort: Cohort, hits: DataFrame, k: int, flank: int = 20) -> DataFrame:
    """``pid, unique_contexts``: distinct surroundings of a pattern's hits, the hit and 20 bases either side within the contig."""
    c = cohort.contigs.select("asm_id", "contig_ix", F.col("len").alias("clen"), "boff")
    rows = hits.join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"])
    lo, hi = F.greatest(F.col("pos") - flank, F.lit(0)), F.least(F.col("pos") + k + flank, F.col("clen"))
    rows = rows.select(F.struct("pid", "contig_ix", "pos", "strand").alias("id"), "asm_id", (F.col("boff") + lo).alias("start"), (hi - lo).alias("length"), (F.col("strand") == 1).alias("rc"))
    seen = cohort.windows(rows, case=False)
    return seen.groupBy(F.col("id.pid").alias("pid")).agg(F.countDistinct(F.xxhash64("seq"), F.length("seq")).alias("unique_contexts"))


def locate(cohort: Cohort, ops: DataFrame, points: DataFrame) -> DataFrame:
    """``points(.., asm_id, pos)`` on the stream -> with ``cls`` (0 literal, 1 copy, 3 copy of the other strand), ``ref_pos`` and ``ref_strand``.

    Given the pieces that ``chains.resolved`` makes of ops, also 2 (reached through copies within the block) and ``hops``.
    """
    p = points.withColumn("block_ix", F.floor(F.col("pos") / cohort.q)).withColumn("o", (F.col("pos") % cohort.q).cast("int"))
    hops = ["hops"] if "hops" in ops.columns else []
    both = p.join(ops.select("asm_id", "block_ix", "kind", "dst", "len", "src", *hops), ["asm_id", "block_ix"]).where("o >= dst and o < dst + len")
    at = F.when(F.col("kind") == 1, F.col("src") + F.col("o") - F.col("dst")).when(F.col("kind") == 3, F.col("src") + F.col("len") - 1 - (F.col("o") - F.col("dst")))
    cls = F.when((F.col("hops") > 0) & (F.col("kind") != 0), 2).otherwise(F.col("kind")) if hops else F.col("kind")
    return both.select(*points.columns, cls.alias("cls"), at.alias("ref_pos"), F.when(F.col("kind") == 1, "+").when(F.col("kind") == 3, "-").alias("ref_strand"), *hops)


def tilemap(cohort: Cohort, ops: DataFrame, w: int) -> DataFrame:
    """Windows end to end, with the hull of their two ends in the reference, where both ends are copies of the same strand."""
    tiles = cohort.tiles(w).withColumn("first", F.col("boff") + F.col("start0")).drop("boff")
    ends = tiles.select("asm_id", "contig_ix", "start0", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("pos")), F.struct(F.lit(1).alias("end"), (F.col("first") + w - 1).alias("pos")))).alias("e"))
    found = locate(cohort, ops, ends.select("asm_id", "contig_ix", "start0", "e.end", "e.pos"))
    side = lambda c, e: F.max(F.when(F.col("end") == e, F.col(c)))
    rows = found.groupBy("asm_id", "contig_ix", "start0").agg(side("cls", 0).alias("cls_start"), side("cls", 1).alias("cls_end"), side("ref_pos", 0).alias("p"), side("ref_pos", 1).alias("q"), side("ref_strand", 0).alias("s"), side("ref_strand", 1).alias("t"))
    both = F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("s") == F.col("t"))
    lo, hi = F.when(both, F.least("p", "q")), F.when(both, F.greatest("p", "q") + 1)
    return rows.select("asm_id", "contig_ix", "start0", lo.alias("ref_lo"), hi.alias("ref_hi"), F.when(both, F.col("s")).alias("strand"), "cls_start", "cls_end")


def in_hull(tiles: DataFrame, w: int) -> DataFrame:
    """Tiles whose hull is within w div 10 of the window's length."""
    return tiles.where(F.abs(F.col("ref_hi") - F.col("ref_lo") - w) <= w // 10)


def leak(tiles: DataFrame, w: int, train: DataFrame) -> DataFrame:
    """How much of each test tile's hull the training tiles cover. ``train``: tiles with a boolean ``train``.

    One row: test windows, the shares covered by half, by 90 % and not at all, the mean and median share, the bases covered.
    """
    # read by both sides, and in several steps of the union: the tiles are located once
    rows = Scratch(train.sparkSession).save(in_hull(train, w).select("asm_id", "contig_ix", "start0", "ref_lo", "ref_hi", "train"), "hulls")
    union = joins.merged(rows.where("train").select(F.lit(0).alias("k"), F.col("ref_lo").alias("lo"), F.col("ref_hi").alias("hi")), ["k"])
    test = rows.where("not train").select("asm_id", "contig_ix", "start0", F.col("ref_lo").alias("lo"), F.col("ref_hi").alias("hi"), F.lit(0).alias("k"))
    spans = union.select("k", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    hit = joins.overlap_join(test, spans, ["k"], max(w, 1024)).withColumn("n", F.least("hi", "rhi") - F.greatest("lo", "rlo"))
    found = hit.groupBy("asm_id", "contig_ix", "start0").agg(F.sum("n").alias("n"))
    each = test.join(found, ["asm_id", "contig_ix", "start0"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / (F.col("hi") - F.col("lo")))
    return each.agg(
        F.count("*").alias("test_windows"), F.count_if(F.col("share") >= 0.5).alias("half"), F.count_if(F.col("share") >= 0.9).alias("ninety"), F.count_if(F.col("share") == 0).alias("zero"),
        F.round(F.avg("share"), 9).alias("mean_share"), F.round(F.median("share"), 9).alias("median_share"), F.coalesce(F.sum("n"), F.lit(0)).alias("bases_covered"),
    )


def by_people(tiles: DataFrame, names: DataFrame, seed: int | None = None) -> DataFrame:
    """Tiles with ``train``: half of the individuals (one fewer, if they are odd in number) train, the first in the order of a seeded hash of
    their names; without a seed they go to training and test in turn, in order of their names.

    Individuals are ranked in one task, a row each.
    """
    people = names.withColumn("person", B.individual(F.col("assembly")))
    each = people.select("person").distinct()
    if seed is None:
        order = each.withColumn("train", F.row_number().over(W.orderBy("person")) % 2 == 1)
    else:
        rank, n = F.row_number().over(W.orderBy(B.drawn(F.col("person"), seed), "person")), F.count("*").over(W.partitionBy())
        order = each.select("person", (rank <= F.floor(n / 2)).alias("train"))
    return tiles.join(joins.broadcast_if_small(people.join(order, "person").select("asm_id", "train")), "asm_id")


def by_locus(tiles: DataFrame, chunk: int, seed: int | None = None) -> DataFrame:
    """Tiles with ``train``: a seeded coin for each stretch of ``chunk`` reference bases, or every other one without a seed; tiles that cross stretches go."""
    at = F.floor(F.col("ref_lo") / chunk)
    coin = at % 2 == 0 if seed is None else B.drawn(at, seed) % 2 == 0
    return tiles.where(at == F.floor((F.col("ref_hi") - 1) / chunk)).withColumn("train", coin)


def tile_summary(tiles: DataFrame, w: int) -> DataFrame:
    """One row: windows, those with both ends located on one strand, those with an end in a literal, those of the first whose hull is over 10 % off."""
    both = F.col("ref_lo").isNotNull()
    literal = (F.col("cls_start") == 0) | (F.col("cls_end") == 0)
    off = both & (F.abs(F.col("ref_hi") - F.col("ref_lo") - w) > w // 10)
    return tiles.agg(F.count("*").alias("windows"), F.count_if(both).alias("both_ends"), F.count_if(literal).alias("literal_end"), F.count_if(off).alias("span_off"))


def copy_shares(ops: DataFrame) -> DataFrame:
    """One row: bases, the percentages that are copies of the reference, of those on its other strand, copies within a block and literals; copies of the
    reference and their mean length."""
    n = F.col("len").cast("long")
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), n)), F.lit(0))
    rows = ops.agg(F.sum(n).alias("bases"), of(1, 3).alias("ref"), of(3).alias("rc"), of(2).alias("own"), of(0).alias("lit"), F.count_if(F.col("kind").isin(1, 3)).alias("copies"))
    share = lambda c: (100 * F.col(c) / F.col("bases")).alias(f"{c}_percent")
    return rows.select("bases", share("ref"), share("rc"), share("own"), share("lit"), "copies", F.try_divide("ref", "copies").alias("mean_copy"))


def code_lengths(ops: DataFrame) -> DataFrame:
    """``(field, context, symbols, bits)``: what each field of the ops costs under models that count it, the sum of -log2 of each symbol's share.

    Fields are kind, log2 of the length, and the distance in bits to where the copy before in the block leads; contexts are none,
    the kind before, and the op's own kind. Grouped counts only: symbols and contexts are a few dozen.
    """
    by = W.partitionBy("asm_id", "block_ix").orderBy("op_ix")
    locus = F.when(F.col("kind") == 3, F.col("src") + F.col("len") - 1).when(F.col("kind") == 1, F.col("src"))
    leads = F.when(F.col("kind") == 3, F.col("src") - 1).when(F.col("kind") == 1, F.col("src") + F.col("len"))
    rows = ops.select("*", locus.alias("locus"), leads.alias("leads")).withColumn("was", F.coalesce(F.lag("kind").over(by), F.lit(-1)))
    rows = rows.withColumn("near", F.last("leads", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)))
    jump = F.when(F.col("locus").isNotNull(), F.coalesce(F.length(F.bin(F.abs(F.col("locus") - F.col("near")))).cast("int"), F.lit(-1)))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), v.cast("int").alias("symbol")) for n, v in (("kind", F.col("kind")), ("length", F.length(F.bin(F.col("len").cast("long")))), ("jump", jump))))
    contexts = F.array(F.struct(F.lit("none").alias("context"), F.lit(0).alias("c")), F.struct(F.lit("kind before").alias("context"), F.col("was").alias("c")), F.struct(F.lit("own kind").alias("context"), F.col("kind").alias("c")))
    each = rows.select(F.explode(fields).alias("f"), contexts.alias("x")).where("f.symbol is not null").select("f.field", "f.symbol", F.explode("x").alias("x"))
    n = each.groupBy("field", F.col("x.context").alias("context"), F.col("x.c").alias("c"), "symbol").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("field", "context", "c"))
    n = n.withColumn("bits", F.col("n") * (F.log2(total) - F.log2("n")))
    return n.groupBy("field", "context").agg(F.sum("n").alias("symbols"), F.sum("bits").alias("bits"))


def haplotype_coverage(cohort: Cohort, spans: DataFrame) -> DataFrame:
    """``(asm_id, length, covered, uncovered_share)``: the bases of each assembly that its runs cover."""
    c = cohort.contigs.select("asm_id", "contig_ix", "boff")
    own = spans.join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"]).select("asm_id", (F.col("boff") + F.col("a")).alias("lo"), (F.col("boff") + F.col("a") + F.col("len")).alias("hi"))
    return joins.covered(own, ["asm_id"], cohort.contigs.groupBy("asm_id").agg(F.sum("len").alias("length")))


def copy_statistics(ops: DataFrame) -> DataFrame:
    """By kind of op: how many, bases, mean length."""
    return ops.groupBy("kind").agg(F.count("*").alias("ops"), F.sum(F.col("len").cast("long")).alias("bases"), F.avg("len").alias("mean_len"))


def literal_records(cohort: Cohort, ops: DataFrame, least: int = 64) -> DataFrame:
    """Literal runs of ``least`` bases and more, as FASTA records."""
    name = F.concat(F.lit(">"), F.col("asm_id").cast("string"), F.lit(":"), (F.col("block_ix") * cohort.q + F.col("dst")).cast("string"))
    return ops.where((F.col("kind") == 0) & (F.col("len") >= least)).select(F.concat(name, F.lit("\n"), F.col("lit").cast("string"), F.lit("\n")).alias("record"))


def pattern_candidates(cohort: Cohort, ops: DataFrame, spans: DataFrame, k: int = kmers.K) -> DataFrame:
    """``(class, asm_id, contig_ix, pos)``: places for test patterns by what the edits are there.

    ``lit`` inside a literal run, ``boundary`` across a run's end, ``short_ins`` across a literal run shorter than k between two
    runs, ``self_copy`` inside a copy within a block, ``ref`` inside a run, ``contig_end`` at a contig's last window, ``block_edge`` across a block's end.
    """
    c = cohort.contigs.where(F.col("len") >= k).select("asm_id", "contig_ix", "len", "boff")
    by = W.partitionBy("asm_id", "contig_ix").orderBy("a", "end")
    ends = c.select("asm_id", "contig_ix", F.explode(F.array(F.lit(0).cast("long"), F.col("len"))).alias("a")).withColumn("end", F.col("a"))
    marks = spans.select("asm_id", "contig_ix", "a", (F.col("a") + F.col("len")).alias("end")).union(ends)
    after = marks.withColumn("next", F.lead("a").over(by)).withColumn("len", F.col("end") - F.col("a"))
    pick = lambda df, name, pos: df.select(F.lit(name).alias("class"), "asm_id", "contig_ix", pos.cast("long").alias("pos"))
    gap = F.col("next") - F.col("end")
    parts = [
        pick(after.where(F.col("len") >= k), "ref", F.col("a") + F.floor((F.col("len") - k) / 2)),
        pick(after.where((gap == 0) & (F.col("len") > 0)), "boundary", F.col("end") - k // 2),
        pick(after.where((gap > 0) & (gap < k) & (F.col("len") > 0)), "short_ins", F.col("end") - F.floor((k - gap) / 2)),
        pick(after.where(gap >= k), "lit", F.col("end") + F.floor((gap - k) / 2)),
        pick(c, "contig_end", F.col("len") - k),
    ]
    own = ops.where((F.col("kind") == 2) & (F.col("len") >= k)).select("asm_id", (F.col("block_ix") * cohort.q + F.col("dst") + F.floor((F.col("len") - k) / 2)).alias("pos"))
    parts.append(pick(cohort.contig_of(own), "self_copy", F.col("start0")))
    edges = c.withColumn("b", joins.bins(F.col("boff") + 1, F.col("boff") + F.col("len"), cohort.q)).where("b > 0")
    parts.append(pick(edges, "block_edge", F.col("b") * cohort.q - F.col("boff") - k // 2))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.join(c.select("asm_id", "contig_ix", "len"), ["asm_id", "contig_ix"]).where((F.col("pos") >= 0) & (F.col("pos") + k <= F.col("len"))).select("class", "asm_id", "contig_ix", "pos")


def generate_patterns(cohort: Cohort, candidates: DataFrame, caps: dict[str, int], k: int = kmers.K) -> DataFrame:
    """``(pid, class, seq)``: a capped sample of each class, in the order of a hash of the place; of equal sequences one stays."""
    spread = F.xxhash64("asm_id", "contig_ix", "pos")
    cap = F.coalesce(*(F.when(F.col("class") == name, n) for name, n in caps.items()), F.lit(0))
    rank = F.row_number().over(W.partitionBy("class").orderBy(spread, "asm_id", "contig_ix", "pos"))
    some = candidates.distinct().withColumn("i", rank).where(F.col("i") <= cap).drop("i")
    c = cohort.contigs.select("asm_id", "contig_ix", "boff")
    rows = some.join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"])
    rows = rows.select(F.struct("class", "asm_id", "contig_ix", "pos").alias("id"), "asm_id", (F.col("boff") + F.col("pos")).alias("start"), F.lit(k).cast("long").alias("length"), F.lit(False).alias("rc"))
    seqs = cohort.windows(rows, case=False).where(B.is_acgt(F.col("seq")))
    one = seqs.groupBy("seq").agg(F.min("id").alias("id"))
    return one.select(F.pmod(F.xxhash64("id"), F.lit(2**53)).alias("pid"), F.col("id.class").alias("class"), "seq")


def jump_histogram(ops: DataFrame) -> DataFrame:
    """Copies by strand change and log2 of the distance between where the copy before leads and where they are."""
    by = W.partitionBy("asm_id", "block_ix").orderBy("op_ix")
    copies = ops.where("kind in (1, 3)")
    diag = F.when(F.col("kind") == 1, F.col("src") - F.col("dst")).otherwise(F.col("src") + F.col("len") - 1 + F.col("dst"))
    copies = copies.withColumn("diag", diag).withColumn("was", F.lag("diag").over(by)).withColumn("kind0", F.lag("kind").over(by)).where("was is not null")
    locus = F.when(F.col("kind0") == 1, F.col("was") + F.col("dst")).otherwise(F.col("was") - F.col("dst"))
    here = F.when(F.col("kind") == 1, F.col("src")).otherwise(F.col("src") + F.col("len") - 1)
    return copies.groupBy((F.col("kind") == F.col("kind0")).alias("same_strand"), F.ceil(F.log2(F.abs(here - locus) + 1)).alias("log2_distance")).agg(F.count("*").alias("n"))
