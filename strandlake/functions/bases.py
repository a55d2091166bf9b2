"""Column functions over sequences of bases. Sequences are strings of one byte characters, at most a chunk long, or binary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, CODES = "ACGT", "0123"


def complement(seq: Column) -> Column:
    """A-T and C-G, case kept; every other letter stays."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def complement_upper(seq: Column) -> Column:
    """A-T and C-G in upper case only, as copies from the reference's other strand use it."""
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def tokens(seq: Column) -> Column:
    """A string of digits: A 0, C 1, G 2, T 3 in either case, everything else 4."""
    return F.regexp_replace(F.translate(F.upper(seq), BASES, CODES), "[^0-3]", "4")


def token_ids(seq: Column, ids: tuple[int, int, int, int, int] = (0, 1, 2, 3, 4)) -> Column:
    """An array of model ids for A, C, G, T and everything else."""
    table = F.array(*(F.lit(i) for i in ids))
    return F.transform(F.split(tokens(seq), ""), lambda c: F.element_at(table, c.cast("int") + 1))


def is_acgt(seq: Column) -> Column:
    """Upper-case A, C, G and T only."""
    return (F.length(seq) > 0) & (F.translate(seq, BASES, "") == "")


def code(kmer: Column) -> Column:
    """The 2-bit code of up to 31 bases, the first base highest; text order is code order."""
    return F.conv(F.translate(kmer, BASES, CODES), 4, 10).cast("long")


def from_code(value: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), k, "0"), CODES, BASES)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def mismatches(a: Column, b: Column) -> Column:
    """Differing bases of two 2-bit codes."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def blocks_touched(start: Column, length: Column, q: int) -> Column:
    return F.floor((start + length - 1) / q) - F.floor(start / q) + 1


def record_name(header: Column) -> Column:
    """A FASTA header up to the first space or tab."""
    return F.regexp_extract(header, r"^[^ \t]*", 0)


def individual(assembly: Column) -> Column:
    """The individual of an assembly name ``<prefix>_<individual>.<haplotype>``: the prefix may be missing."""
    return F.regexp_extract(assembly, r"^(?:[^_]*_)?([^._]+)", 1)


def lowered(seq: Column, runs: Column) -> Column:
    """Lower-case ``seq`` over an array of structs (from, n), from counted from 0."""
    step = lambda s, r: F.overlay(s, F.lower(F.substring(s, r["from"] + 1, r["n"])), r["from"] + 1, r["n"])
    return F.when(F.size(runs) > 0, F.aggregate(runs, seq, step)).otherwise(seq)


def wrapped(seq: Column, width: Column) -> Column:
    """Lines of ``width`` characters, each with a line end; nothing for an empty sequence. One pass over the sequence."""
    full = F.regexp_replace(seq, F.concat(F.lit("(?s).{"), width.cast("string"), F.lit("}")), F.lit("$0\n"))
    end = F.when(F.length(seq) % width == 0, F.lit("")).otherwise(F.lit("\n"))
    return F.when(F.length(seq) == 0, F.lit("")).otherwise(F.concat(full, end))


def drawn(key: Column, seed: int, k: int = 0) -> Column:
    """The ``k``-th draw of a key: a number under 2^60, the first 15 digits of an md5 of key, seed and k, the same on any cluster."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f" {seed} {k}"))), 1, 15), 16, 10).cast("long")


def entropy(seq: Column) -> Column:
    """Bits per base of the composition."""
    n = F.length(seq)
    parts = []
    for b in BASES:
        p = (n - F.length(F.replace(seq, F.lit(b), F.lit("")))) / n
        parts.append(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return reduce(lambda a, b: a + b, parts)


def period_share(seq: Column, period: int, k: int) -> Column:
    """The share of a k-mer's bases that equal the one ``period`` before."""
    same = [(F.substring(seq, i + 1, 1) == F.substring(seq, i + 1 - period, 1)).cast("int") for i in range(period, k)]
    return reduce(lambda a, b: a + b, same) / float(k - period)


def is_simple_repeat(seq: Column, k: int) -> Column:
    """Under 1.5 bits per base, or a period of 1, 2 or 3 in at least 90 % of it."""
    return reduce(lambda a, b: a | b, (period_share(seq, p, k) >= 0.9 for p in (1, 2, 3)), entropy(seq) < 1.5)
