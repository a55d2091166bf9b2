"""Cohorts over the driver's tables, ingested once per session and folder.

The text cohort: every letter of ``documents.text`` stands for a base, a source is an assembly, a document a contig; every
fourth document is stored reverse-complemented, so that both strands occur. The reference is the documents of ``src0``.
The mutated cohort: ``src0``'s documents once more for each of four individuals with two haplotypes, with substitutions at
places that arithmetic on the position gives; it is nearly the reference, as real assemblies are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators.cohort import Cohort
from strandlake.scratch import Scratch

Q, REF, WIDTH = 1024, "src0", 60
LETTERS = "abcdefghijklmnopqrstuvwxyz .,"
HAPLOTYPES = 8


def projected(text: Column) -> Column:
    """Text as bases: letters, space, dot and comma in turn A C G T, everything else N."""
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, ("ACGT" * 8)[: len(LETTERS)]), "[^ACGT]", "N")


_BASE = np.full(256, ord("N"), np.uint8)
_BASE[[ord(c) for c in LETTERS]] = np.frombuffer(("ACGT" * 8)[: len(LETTERS)].encode(), np.uint8)
_BASE[[65, 67, 71, 84]] = [65, 67, 71, 84]
_COMP = np.arange(256, dtype=np.uint8)
_COMP[[65, 67, 71, 84]] = [84, 71, 67, 65]


def bases(text: bytes, turned: bool = False) -> bytes:
    """What ``projected`` makes of a text that is in lower case already, given as UTF-8; the reverse complement of it, if ``turned``."""
    x = np.frombuffer(text, np.uint8)
    x = _BASE[x[(x & 0xC0) != 0x80]]  # a character is one base, however many bytes it has
    return (_COMP[x[::-1]] if turned else x).tobytes()


def _contigs(docs: DataFrame, turn: bool) -> DataFrame:
    """``(assembly, order, header, line_width, len, seq)``; with ``turn`` every fourth one is the reverse complement."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    turned = (F.col("doc_id") % 4 == 3) if turn else F.lit(False)
    rows = docs.select(F.col("source").alias("assembly"), F.col("doc_id").alias("order"), F.concat_ws(" ", name, "lang").alias("header"), F.lit(WIDTH).alias("line_width"), F.coalesce(turned, F.lit(False)).alias("turned"), F.lower("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [None if x is None else bases(x, t) for x, t in zip(b.column(5).to_pylist(), b.column(4).to_pylist(), strict=True)]
            n = pa.array([None if x is None else len(x) for x in seqs], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], n, pa.array(seqs, pa.binary())], ["assembly", "order", "header", "line_width", "len", "seq"])

    return rows.mapInArrow(run, "assembly string, order long, header string, line_width int, len long, seq binary")


class World:
    """Each part is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.scratch = spark, sf_dir, Scratch(spark)

    def _docs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")

    @cached_property
    def contigs(self) -> DataFrame:
        """Those of the reference."""
        return self.scratch.save(_contigs(self._docs().where(F.col("source") == REF), False), "projected")

    @cached_property
    def people(self) -> tuple[DataFrame, DataFrame]:
        """The contigs of the mutated cohort, for cohorts of other block sizes, and what they are without their bases."""
        return haplotypes(self.contigs, HAPLOTYPES)

    @cached_property
    def text(self) -> Cohort:
        rows = self.scratch.save(_contigs(self._docs(), True), "projected")
        return Cohort.build(rows, Q, case_runs(rows), rows.drop("seq"))

    @cached_property
    def mutated(self) -> Cohort:
        return Cohort.build(self.people[0], Q, meta=self.people[1])

    @cached_property
    def reference(self) -> Cohort:
        return Cohort.build(self.contigs, Q, meta=self.contigs.drop("seq"))

    @cached_property
    def patterns(self) -> DataFrame:
        items = self.spark.read.parquet(f"{self.sf_dir}/benchmark.parquet").select("item_id", projected(F.col("text")).alias("seq"))
        windows = items.select("item_id", "seq", F.explode(F.when(F.length("seq") >= 23, F.sequence(F.lit(0), F.length("seq") - 23, F.lit(16))).otherwise(F.array().cast("array<int>"))).alias("at"))
        windows = windows.select((F.col("item_id") * 1000 + F.col("at")).alias("n"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("class"), F.substring("seq", F.col("at") + 1, F.lit(23)).alias("seq"))
        return self.scratch.save(first_of_each(windows.where(B.is_acgt(F.col("seq")))), "patterns")

    @cached_property
    def guides(self) -> DataFrame:
        return self.scratch.save(guides_of(self.reference, 40), "guides")


_made: dict[tuple[str, str], World] = {}


def case_runs(contigs: DataFrame) -> DataFrame:
    """20 lower-case bases from every 10th of 100 bases of each assembly's stream."""
    n = contigs.groupBy("assembly").agg(F.sum("len").alias("n"))
    each = F.explode(F.when(F.col("n") >= 30, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 30) / 100))).otherwise(F.array().cast("array<bigint>")))
    return n.select("assembly", each.alias("k")).select("assembly", (F.col("k") * 100 + 10).alias("start"), F.lit(20).cast("long").alias("len"))


def mutated(seq: bytes, individual: int) -> bytes:
    """A base changes to its complement at every position p (from 0) with (p * 7919 + individual * 104729) mod 300 = 0."""
    # 7919 is 119 mod 300, and 119 * 179 is 1 mod 300: the places are those of one remainder
    x = np.frombuffer(seq, np.uint8).copy()
    first = -individual * 104729 * 179 % 300
    x[first::300] = _COMP[x[first::300]]
    return x.tobytes()


def haplotypes(ref: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The contigs of ``n`` haplotypes, two an individual, and what they are without their bases."""
    people = ref.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    label = F.concat(F.lit("y1_P"), F.floor(F.col("i") / 2).cast("string"), F.lit("."), (F.col("i") % 2 + 1).cast("string"))
    people = people.select(label.alias("assembly"), "order", "header", "line_width", "len", "i", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [None if x is None else mutated(x, i) for x, i in zip(b.column(6).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(seqs, pa.binary())], ["assembly", "order", "header", "line_width", "seq"])

    return people.mapInArrow(run, "assembly string, order long, header string, line_width int, seq binary"), people.drop("i", "seq")


@dataclass
class Many:
    """A cohort of many haplotypes with its runs and the bases that no run holds."""

    cohort: Cohort
    spans: DataFrame
    gaps: DataFrame


_many: dict[tuple[str, str], Many] = {}


def many(spark: SparkSession, sf_dir: str, n: int = 64) -> Many:
    """64 haplotypes of the reference; their assemblies are numbered by name, so the edits' rule takes the haplotype from it."""
    from strandlake.operators import edits

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _many:
        w = world(spark, sf_dir)
        people, meta = haplotypes(w.contigs, n)
        c = Cohort.build(people, Q, meta=meta)
        spans = Scratch(spark).save(edits.runs(c, known_edits(c)), "runs")
        _many[key] = Many(c, spans, edits.stored_gaps(c, spans))
    return _many[key]


def world(spark: SparkSession, sf_dir: str) -> World:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = World(spark, sf_dir)
    return _made[key]


_near: dict[tuple[str, str], Cohort] = {}


def near(spark: SparkSession, sf_dir: str) -> Cohort:
    """The text cohort, stored so that requests go to their blocks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _near:
        _near[key] = world(spark, sf_dir).text.colocated(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _near[key]


def first_of_each(candidates: DataFrame) -> DataFrame:
    """``candidates(n, class, seq)`` -> ``patterns(pid, class, seq)``: of equal sequences the first class and number stays."""
    return candidates.groupBy("seq").agg(F.min(F.struct("class", "n")).alias("x")).select(F.col("x.n").alias("pid"), F.col("x.class").alias("class"), "seq")


def guides_of(reference: Cohort, n: int) -> DataFrame:
    """``guides(gid, spacer)``: ``n`` spacers that NGG follows in the reference, the first in the order of a hash of their place."""
    from strandlake.operators import kmers

    spread = (F.col("contig_ix") * 7919 + F.col("pos") * 104729) % 1_000_003
    # as 2-bit codes, whose order is that of the text
    rows = kmers.pam_windows(reference, minus=False).select("spacer", spread.alias("o"), "contig_ix", "pos").groupBy("spacer").agg(F.min(F.struct("o", "contig_ix", "pos")).alias("at"))
    rows = rows.orderBy("at", "spacer").limit(n)
    return rows.select((F.col("at.o") * 1000 + F.col("at.pos") % 1000).alias("gid"), B.from_code(F.col("spacer"), kmers.SPACER).alias("spacer"))


def known_edits(mutated: Cohort) -> DataFrame:
    """The ``ops`` of the mutated cohort by the rule that made it: the stream is the reference's but for a literal base at each substitution."""
    q = mutated.q
    parts = F.regexp_extract("assembly", r"P(\d+)\.(\d+)$", 1).cast("long"), F.regexp_extract("assembly", r"P(\d+)\.(\d+)$", 2).cast("long")
    first = F.pmod(-(2 * parts[0] + parts[1] - 1) * 104729 * 179, F.lit(300)).cast("long")
    at = F.when(F.col("len") > first, F.sequence(first, F.col("len") - 1, F.lit(300).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    subs = mutated.contigs.select("asm_id", "boff", F.explode(at).alias("p")).select("asm_id", (F.col("boff") + F.col("p")).alias("g"))
    lits = mutated.blocks.select("asm_id", "block_ix", "blen", F.col("seq").cast("string").alias("seq"))
    marks = subs.groupBy("asm_id", F.floor(F.col("g") / q).alias("block_ix")).agg(F.array_sort(F.collect_list((F.col("g") % q).cast("int"))).alias("at"))
    rows = lits.join(marks, ["asm_id", "block_ix"], "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    ends = F.concat(F.array(F.lit(-1)), F.col("at"), F.array(F.col("blen").cast("int")))
    gap = lambda i: F.struct(F.lit(1).alias("kind"), (F.get("ends", i) + 1).alias("dst"), (F.get("ends", i + 1) - F.get("ends", i) - 1).alias("len"))
    rows = rows.withColumn("ends", ends)
    copies = F.transform(F.sequence(F.lit(0), F.size("at")), gap)
    singles = F.transform("at", lambda o: F.struct(F.lit(0).alias("kind"), o.alias("dst"), F.lit(1).alias("len")))
    both = F.array_sort(F.transform(F.filter(F.concat(copies, singles), lambda x: x["len"] > 0), lambda x: F.struct(x["dst"].alias("dst"), x["kind"].alias("kind"), x["len"].alias("len"))))
    each = rows.select("asm_id", "block_ix", "seq", F.posexplode(both).alias("op_ix", "x"))
    src = F.when(F.col("x.kind") == 1, F.col("block_ix") * q + F.col("x.dst")).otherwise(F.lit(0)).cast("long")
    lit = F.when(F.col("x.kind") == 0, F.expr("substring(seq, x.dst + 1, 1)").cast("binary"))
    return each.select("asm_id", "block_ix", "op_ix", "x.kind", "x.dst", "x.len", src.alias("src"), lit.alias("lit"))
