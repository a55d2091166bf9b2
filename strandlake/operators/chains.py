"""Copies within a block: found in what alignment left literal, and resolved to what they stand for.

An op of kind 2 copies bases of its own block that lie before it, which may be copies themselves, or its own first bases over and over. So a
base stands at the end of a chain. Chains are resolved block by block by pointer jumping: every base points to the one
it copies, and each round points it where that one points, so rounds grow with the logarithm of the longest chain. A block is
16,384 bases at most, which bounds a row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import kmers
from strandlake.operators.cohort import Cohort
from strandlake.scratch import Scratch

#: Words that name a place's earlier likenesses, how many of these are tried, and what a copied base gains against what a copy costs.
WORD, TRIED, GAIN, COST = 12, 32, 0.27, 5.0
_OP = "struct<op_ix:int,kind:int,dst:int,len:int,src:bigint,lit:binary>"
RESOLVED = "asm_id int, block_ix long, dst int, len int, kind int, src long, hops int, lit binary"


def _by_block(ops: DataFrame) -> DataFrame:
    """``(asm_id, block_ix, ops)``, a block's ops in order."""
    one = F.struct("op_ix", "kind", "dst", "len", "src", "lit")
    return ops.groupBy("asm_id", "block_ix").agg(F.array_sort(F.collect_list(one)).alias("ops"))


#: A copy shorter than this costs more than it gains.
LEAST = int(COST / GAIN) + 1


def _earlier(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a block how long it agrees with an earlier one, the best of those tried, and how far back that is; agreements under LEAST
    bases are left out."""
    n = len(x)
    best, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    c, ok = kmers.codes(x, WORD)
    where = np.flatnonzero(ok)
    if not len(where):
        return best, back
    order = where[np.argsort(c[where], kind="stable")]
    c = c[order]
    away = np.zeros(n, bool)
    for j in range(1, min(TRIED, len(order) - 1) + 1):
        same = np.flatnonzero(c[j:] == c[:-j])
        if not len(same):
            break
        away[order[same + j] - order[same]] = True
    # row d of the matrix has the bases d places before; those before the block are zeros
    padded = np.concatenate((np.zeros(n, np.uint8), np.frombuffer(x, np.uint8)))
    before = np.lib.stride_tricks.as_strided(padded[n:], (n, n), (-1, 1), writeable=False)
    a, here = padded[n:], np.arange(n, dtype=np.int16)
    tried = np.flatnonzero(away)
    for k in range(0, len(tried), 64):
        d = tried[k : k + 64]
        eq = before[d] == a
        long, size = eq, 1
        while size < LEAST:
            step = min(size, LEAST - size)
            long = long[:, :-step] & long[:, step:]
            size += step
        some = long.any(1)
        if not some.any():
            continue
        d, ends = d[some], np.where(eq[some], np.int16(n), here)
        run = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - here
        most = run.max(0)
        better = (most > best) & (most >= LEAST)
        best[better], back[better] = most[better], d[(run[:, better] == most[better]).argmax(0)]
    return best, back


def _parsed(x: bytes, ops: list[dict], found: tuple[np.ndarray, np.ndarray] | None = None) -> list[dict]:
    """The block's ops with literal runs parsed anew: of all ways to write them by copies and literals the one that scores most, a copy of L bases
    scoring GAIN * L - COST. The longest copy at a place is never worse than a shorter one, as what follows loses no more than GAIN by each base."""
    if all(o["kind"] != 0 or o["len"] < LEAST for o in ops):
        return ops
    best, back = _earlier(x) if found is None else found
    out = []
    for o in ops:
        lo, n = o["dst"], o["len"]
        size = np.minimum(best[lo : lo + n], n - np.arange(n)) if o["kind"] == 0 else np.zeros(0, np.int64)
        at = np.flatnonzero(size >= LEAST)
        if not len(at):
            out.append(o)
            continue
        # the score changes only where a copy can begin
        size = size[at]
        after, sizes, places = np.searchsorted(at, at + size).tolist(), size.tolist(), at.tolist()
        score, take = [0.0] * (len(places) + 1), [False] * len(places)
        for i in range(len(places) - 1, -1, -1):
            own = GAIN * sizes[i] - COST + score[after[i]]
            take[i] = own > score[i + 1]
            score[i] = own if take[i] else score[i + 1]
        i = since = 0
        while i < len(places):
            if not take[i]:
                i += 1
                continue
            p = places[i]
            if p > since:
                out.append({"kind": 0, "dst": lo + since, "len": p - since, "src": 0, "lit": x[lo + since : lo + p]})
            out.append({"kind": 2, "dst": lo + p, "len": sizes[i], "src": lo + p - int(back[lo + p]), "lit": None})
            since, i = p + sizes[i], after[i]
        if n > since:
            out.append({"kind": 0, "dst": lo + since, "len": n - since, "src": 0, "lit": x[lo + since : lo + n]})
    return out


def own_copies(cohort: Cohort, ops: DataFrame) -> DataFrame:
    """``ops`` with literal runs parsed into copies within their block (kind 2, ``src`` an earlier place of it) and what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(asm, block, i, o) for asm, block, x, own in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True) for i, o in enumerate(_parsed(x, own))]
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())]
            columns += [pa.array([r[3][c] for r in rows], t) for c, t in (("kind", pa.int32()), ("dst", pa.int32()), ("len", pa.int32()), ("src", pa.int64()), ("lit", pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["asm_id", "block_ix", "op_ix", "kind", "dst", "len", "src", "lit"])

    both = cohort.blocks.select("asm_id", "block_ix", "seq").join(_by_block(ops), ["asm_id", "block_ix"])
    return Scratch(cohort.spark).save(both.mapInArrow(run, "asm_id int, block_ix long, op_ix int, kind int, dst int, len int, src long, lit binary"), "ops")


def chase(ops: list[dict]) -> list[tuple]:
    """A block's ops without copies within it: ``(dst, len, kind, src, hops, lit)``, pieces whose bases go the same number of hops to one op."""
    n = sum(o["len"] for o in ops)
    to, hops, own = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, o in enumerate(ops):
        lo, hi = o["dst"], o["dst"] + o["len"]
        own[lo:hi] = i
        if o["kind"] == 2:
            if not 0 <= o["src"] < lo:
                raise ValueError("a copy within the block of what doesn't lie before it")
            to[lo:hi], hops[lo:hi] = np.arange(o["src"], o["src"] + o["len"]), 1
    while True:
        further = to[to]
        if (further == to).all():
            break
        hops, to = hops + hops[to], further
    new = np.ones(n, bool)
    new[1:] = (to[1:] != to[:-1] + 1) | (hops[1:] != hops[:-1]) | (own[to[1:]] != own[to[:-1]])
    first = np.flatnonzero(new)
    out = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        root, size = int(to[lo]), hi - lo
        o = ops[int(own[root])]
        at = root - o["dst"]
        src = o["src"] + at if o["kind"] == 1 else o["src"] + o["len"] - at - size if o["kind"] == 3 else 0
        out.append((lo, size, o["kind"], src, int(hops[lo]), o["lit"][at : at + size] if o["kind"] == 0 else None))
    return out


def resolved(ops: DataFrame) -> DataFrame:
    """``(asm_id, block_ix, dst, len, kind, src, hops, lit)``: pieces that are literal (0) or copies of the reference (1, or 3 of its other strand) at
    the end of ``hops`` copies within the block, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(asm, block, *piece) for asm, block, own in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for piece in chase(own)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["asm_id", "block_ix", "dst", "len", "kind", "src", "hops", "lit"])

    return _by_block(ops).mapInArrow(run, RESOLVED)


def execute(ops: DataFrame, reference: Cohort) -> DataFrame:
    """``(asm_id, block_ix, seq)``: the blocks that ``ops``, copies within the block too, stand for."""
    from strandlake.operators import edits

    return edits.execute(resolved(ops).withColumnRenamed("dst", "op_ix"), reference)


def located(cohort: Cohort, pieces: DataFrame, reference: Cohort) -> DataFrame:
    """``(cls, n, hops, same)`` over all bases: 1 a copy of the reference, 3 of its other strand, 2 one that is reached through copies within the
    block, 0 a literal; how many hops they go in all, and how many of those located are the base that the reference has there."""
    there = pieces.where("kind <> 0").select(F.struct("asm_id", "block_ix", "dst", "kind", "hops").alias("id"), F.lit(0).alias("asm_id"), F.col("src").alias("start"), F.col("len").cast("long").alias("length"), (F.col("kind") == 3).alias("rc"))
    ref = reference.windows(there, case=False).select("id.*", F.col("seq").alias("ref"))
    blocks = cohort.decode(case=False).select("asm_id", "block_ix", F.col("seq").alias("block"))
    both = ref.join(blocks, ["asm_id", "block_ix"]).withColumn("own", F.expr("substring(block, dst + 1, length(ref))"))
    equal = F.size(F.filter(F.zip_with(F.split("ref", ""), F.split("own", ""), lambda a, b: a == b), lambda x: x))
    same = F.when(F.col("ref") == F.col("own"), F.length("ref")).otherwise(equal).cast("long")
    cls = F.when((F.col("hops") > 0) & (F.col("kind") != 0), 2).otherwise(F.col("kind"))
    counted = pieces.groupBy(cls.alias("cls")).agg(F.sum(F.col("len").cast("long")).alias("n"), F.sum(F.col("hops").cast("long") * F.col("len")).alias("hops"))
    found = both.groupBy(cls.alias("cls")).agg(F.sum(same).alias("same"))
    return counted.join(found, "cls", "left").select("cls", "n", "hops", F.coalesce("same", F.lit(0).cast("long")).alias("same"))
