"""A cohort of assemblies and the queries by coordinate: windows, fetch, sample, decode, FASTA, checks.

Tables (FIXTURES.md): ``contigs(asm_id, assembly, contig_ix, name, header, len, boff, line_width)``;
``blocks(asm_id, block_ix, bstart, blen, seq binary, lower array<struct<from, n>>, sha256)``, Q upper-case bases of an
assembly's stream each; ``chunks(asm_id, contig_ix, cstart, seq binary)``, Q bases of one contig and the OVERLAP that follow,
for searches; ``case_runs(asm_id, start, len)``. Blocks are written in stretches of STRIPE, chunks as their contigs come, both in order of
(asm_id, position) within a file. Each of the three tables is made when it is first asked for: a search needs no blocks, an alignment no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators import fold, joins
from strandlake.scratch import Scratch

#: Bases of the next chunk that a chunk repeats: searches of k-mers up to one more work chunk by chunk.
OVERLAP = 31
SIZES = (1024, 2048, 4096, 16384)
#: Blocks side by side that are put together by one task.
STRIPE = 256


def contig_table(meta: DataFrame) -> DataFrame:
    """``meta(assembly, order, name, header, len, line_width)`` -> the contig table. Names must not repeat in an assembly.

    Assemblies are numbered in order of their names, contigs by ``order``; one row a contig, no bases.
    """
    names = meta.select("assembly").distinct().withColumn("asm_id", (F.row_number().over(W.orderBy("assembly")) - 1).cast("int"))
    rows = meta.join(joins.broadcast_if_small(names), "assembly")
    by = W.partitionBy("asm_id").orderBy("order")
    upto = F.coalesce(F.sum("len").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("contig_ix", (F.row_number().over(by) - 1).cast("int")).withColumn("boff", upto)
    twice = F.count("*").over(W.partitionBy("asm_id", "name")) > 1
    name = F.when(twice, F.raise_error(F.concat(F.lit("contig name used twice: "), "name"))).otherwise(F.col("name"))
    return rows.select("asm_id", "assembly", "contig_ix", name.alias("name"), "header", "len", "boff", "line_width", "order")


def _joined(at: str, part: str) -> Column:
    """An aggregate: the parts of a group end to end, in order of their places."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, part))), lambda s: s[part]), "")


def _glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(asm_id, block_ix, part)`` in order -> a row a block. Parts lie end to end in a batch's buffer, so whole blocks are new bounds over it."""
    names, key, held = ["asm_id", "block_ix", "seq"], None, []

    def last() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([b"".join(held)], pa.binary())], names)

    for b in batches:
        if not b.num_rows:
            continue
        asm, block, part = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).cast(pa.binary())
        first = np.flatnonzero(np.concatenate(([True], (asm[1:] != asm[:-1]) | (block[1:] != block[:-1]))))
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        cut = ends[np.append(first, len(part))]
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut.tobytes()), part.buffers()[2]])
        lo, hi = 0, len(first) - 1  # the last block may go on
        if key == (int(asm[0]), int(block[0])):
            held.append(whole[0].as_py())
            lo = 1
        if key is not None and (lo == 0 or hi > 0):
            yield last()
            key = None
        if lo < hi:
            yield pa.RecordBatch.from_arrays([pa.array(asm[first[lo:hi]], pa.int32()), pa.array(block[first[lo:hi]], pa.int64()), whole[lo:hi]], names)
        if lo <= hi:
            key, held = (int(asm[-1]), int(block[-1])), [whole[hi].as_py()]
    if key is not None:
        yield last()


class Cohort:
    def __init__(self, spark: SparkSession, q: int, contigs: DataFrame, blocks: DataFrame | Callable, chunks: DataFrame | Callable, case_runs: DataFrame | Callable):
        """A table may be given as a function, which is called when the table is first asked for."""
        self.spark, self.q, self.contigs = spark, q, contigs
        self._tables = {"blocks": blocks, "chunks": chunks, "case_runs": case_runs}
        #: ``(assembly, seq)``, the contigs that a cohort was built from, where it was
        self.whole: DataFrame | None = None

    def _table(self, name: str) -> DataFrame:
        if callable(self._tables[name]):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def case_runs(self) -> DataFrame:
        return self._table("case_runs")

    def with_chunks(self, chunks: DataFrame) -> Cohort:
        """The same cohort, of which searches read only ``chunks``."""
        return Cohort(self.spark, self.q, self.contigs, lambda: self.blocks, chunks, lambda: self.case_runs)

    # ---- building

    @classmethod
    def build(cls, contigs: DataFrame, q: int, case_runs: DataFrame | None = None, meta: DataFrame | None = None) -> Cohort:
        """From ``contigs(assembly, order, header, seq, line_width)``, one row a contig, into tables of the shared folder.

        A base's case comes from ``case_runs(assembly, start, len)`` over the stream, if given; ``seq`` is upper-case. ``meta(assembly, order,
        header, len, line_width)``, if given, is what the contigs are without their bases.
        """
        if q not in SIZES:
            raise ValueError(f"block size {q} is none of {SIZES}")
        scratch = Scratch(contigs.sparkSession)
        if meta is None:
            meta = contigs.select("assembly", "order", "header", F.length("seq").cast("long").alias("len"), "line_width")
        meta = meta.select("assembly", "order", B.record_name(F.col("header")).alias("name"), "header", "len", "line_width")
        table = scratch.save(contig_table(meta).coalesce(8), "contigs")
        ids = table.select("assembly", "order", "asm_id", "contig_ix", "len", "boff")

        def whole() -> DataFrame:
            return contigs.select("assembly", "order", F.col("seq").cast("binary").alias("seq")).join(joins.broadcast_if_small(ids), ["assembly", "order"])

        def chunks() -> DataFrame:
            rows = whole().withColumn("chunk", joins.bins(F.lit(0).cast("long"), F.col("len"), q))
            return rows.select("asm_id", "contig_ix", (F.col("chunk") * q).alias("cstart"), F.substring("seq", (F.col("chunk") * q + 1).cast("int"), F.lit(q + OVERLAP)).alias("seq"))

        out = cls._of(scratch, q, table, lambda: whole().withColumn("lo", F.col("boff")), chunks, case_runs)
        out.whole = contigs.select("assembly", F.col("seq").cast("binary").alias("seq"))
        return out

    @classmethod
    def from_pieces(cls, records: DataFrame, pieces: DataFrame, q: int, case_runs: DataFrame | None = None) -> Cohort:
        """From ``records(assembly, order, header, len, line_width)`` and ``pieces(assembly, order, start, seq)`` of their bases: what
        ``build`` makes of whole contigs, with no row longer than a piece."""
        if q not in SIZES:
            raise ValueError(f"block size {q} is none of {SIZES}")
        scratch = Scratch(pieces.sparkSession)
        meta = records.select("assembly", "order", B.record_name(F.col("header")).alias("name"), "header", F.col("len").cast("long"), "line_width")
        table = scratch.save(contig_table(meta).coalesce(8), "contigs")
        ids = table.select("assembly", "order", "asm_id", "contig_ix", "boff")
        own = pieces.select("assembly", "order", "start", F.col("seq").cast("binary").alias("seq")).join(joins.broadcast_if_small(ids), ["assembly", "order"])
        own = own.withColumn("len", F.length("seq").cast("long")).withColumn("lo", F.col("boff") + F.col("start"))
        # a chunk is put together from the pieces that reach into it or into the bases it repeats
        first = F.greatest(F.floor((F.col("start") - (q + OVERLAP)) / q) + 1, F.lit(0))
        last = F.floor((F.col("start") + F.col("len") - 1) / q)
        cut = own.where("len > 0").withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("cstart", F.col("chunk") * q)
        x0, x1 = F.greatest("start", "cstart"), F.least(F.col("start") + F.col("len"), F.col("cstart") + (q + OVERLAP))
        cut = cut.select("asm_id", "contig_ix", "cstart", x0.alias("at"), F.substring("seq", (x0 - F.col("start") + 1).cast("int"), (x1 - x0).cast("int")).cast("string").alias("part"))
        chunks = cut.groupBy("asm_id", "contig_ix", "cstart").agg(_joined("at", "part").cast("binary").alias("seq"))
        return cls._of(scratch, q, table, lambda: own, lambda: chunks, case_runs)

    @classmethod
    def _of(cls, scratch: Scratch, q: int, table: DataFrame, parts: Callable[[], DataFrame], chunks: Callable[[], DataFrame], case_runs: DataFrame | None) -> Cohort:
        """``parts(asm_id, lo, len, seq)``: bases from place ``lo`` of the stream on."""
        spark = scratch.spark
        stripe = F.floor(F.col("block_ix") / STRIPE).alias("stripe")

        def runs() -> DataFrame:
            ids = table.select("assembly", "asm_id").distinct()
            rows = spark.createDataFrame([], "assembly string, start long, len long") if case_runs is None else case_runs
            return scratch.save(rows.join(joins.broadcast_if_small(ids), "assembly").select("asm_id", F.col("start").cast("long"), F.col("len").cast("long")), "case_runs")

        def blocks() -> DataFrame:
            own = parts().withColumn("block_ix", joins.bins(F.col("lo"), F.col("lo") + F.col("len"), q))
            since = F.greatest(F.col("block_ix") * q, F.col("lo"))
            until = F.least((F.col("block_ix") + 1) * q, F.col("lo") + F.col("len"))
            own = own.select("asm_id", "block_ix", since.alias("at"), F.substring("seq", (since - F.col("lo") + 1).cast("int"), (until - since).cast("int")).alias("part"))
            # a task has all of a stripe, so bases are shuffled once and leave it in order
            own = own.repartition("asm_id", stripe).sortWithinPartitions("asm_id", "block_ix", "at").select("asm_id", "block_ix", "part")
            rows = own.mapInArrow(_glued, "asm_id int, block_ix long, seq binary")
            rows = rows.select("asm_id", "block_ix", (F.col("block_ix") * q).alias("bstart"), F.length("seq").alias("blen"), "seq", F.sha2("seq", 256).alias("sha256"))
            return rows

        def cased() -> DataFrame:
            none = F.array().cast("array<struct<from:int,n:int>>")
            order = ["asm_id", "block_ix", "bstart", "blen", "seq", "sha256", "lower"]
            if case_runs is None:
                return scratch.save(blocks().withColumn("lower", none).select(*order), "blocks")
            cut = cohort.case_runs.withColumn("block_ix", joins.bins(F.col("start"), F.col("start") + F.col("len"), q))
            x0 = F.greatest(F.col("start"), F.col("block_ix") * q)
            x1 = F.least(F.col("start") + F.col("len"), (F.col("block_ix") + 1) * q)
            cut = cut.groupBy("asm_id", "block_ix").agg(F.array_sort(F.collect_list(F.struct((x0 - F.col("block_ix") * q).cast("int").alias("from"), (x1 - x0).cast("int").alias("n")))).alias("lower"))
            return scratch.save(blocks().join(cut, ["asm_id", "block_ix"], "left").withColumn("lower", F.coalesce("lower", none)).select(*order), "blocks")

        cohort = cls(spark, q, table.drop("order"), cased, lambda: scratch.save(chunks().sortWithinPartitions("asm_id", "contig_ix", "cstart"), "chunks"), runs)
        return cohort

    # ---- metadata

    def subset(self, assemblies: list[str]) -> Cohort:
        """Only these assemblies; one that isn't there is an error."""
        there = {r.assembly: r.asm_id for r in self.contigs.where(F.col("assembly").isin(assemblies)).select("assembly", "asm_id").distinct().collect()}
        if missing := [a for a in assemblies if a not in there]:
            raise FileNotFoundError(f"no such assembly: {', '.join(missing)}")
        only = F.col("asm_id").isin(list(there.values()))
        return Cohort(self.spark, self.q, self.contigs.where(only), *(lambda n=n: self._table(n).where(only) for n in ("blocks", "chunks", "case_runs")))

    def colocated(self, buckets: int) -> Cohort:
        """The same cohort, its blocks stored in buckets of (assembly, block), a file each.

        Requests are then shuffled to the blocks that they touch, and blocks not at all; requests of one block meet in one task in
        whatever order they come. A window that spans blocks is put together by a second shuffle of its parts. Worth it where
        many batches of requests meet one cohort: the blocks are shuffled once, when they are stored.
        """
        keys = ["asm_id", "block_ix"]
        blocks = Scratch(self.spark).save_by(self.blocks.repartition(buckets, *keys), "blocks", keys, buckets)
        return Cohort(self.spark, self.q, self.contigs, blocks, lambda: self.chunks, lambda: self.case_runs)

    def names(self) -> DataFrame:
        return self.contigs.select("asm_id", "assembly").distinct()

    def info(self) -> DataFrame:
        """A row for each assembly: contigs, bases, blocks, block size."""
        bases = F.sum("len")
        return self.contigs.groupBy("asm_id", "assembly").agg(F.count("*").alias("contigs"), bases.alias("nbases"), F.ceil(bases / self.q).alias("nblocks")).withColumn("q", F.lit(self.q))

    def resident_bytes(self) -> DataFrame:
        """Bytes that a loaded cohort takes, by component and in total."""
        parts = [
            self.blocks.agg(F.sum("blen").alias("b")).select(F.lit("bases").alias("component"), "b"),
            self.blocks.agg((F.count("*") * 16).alias("b")).select(F.lit("block table").alias("component"), "b"),
            self.case_runs.agg((F.count("*") * 16).alias("b")).select(F.lit("case runs").alias("component"), "b"),
            self.contigs.agg((F.count("*") * 24 + F.sum(F.octet_length("header"))).alias("b")).select(F.lit("contigs").alias("component"), "b"),
        ]
        rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
        return rows.rollup("component").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).select(F.coalesce("component", F.lit("total")).alias("component"), "bytes")

    # ---- queries by coordinate

    def windows(self, requests: DataFrame, case: bool = True, tokens: bool = False) -> DataFrame:
        """``requests(id, asm_id, start, length, rc)`` over an assembly's stream -> the same with ``seq``.

        Windows may cross contigs but not the assembly's end. Case, then the reverse complement, then tokens (which drop the
        case). Requests are exploded to the blocks that they touch, which are joined by key; no block else is decoded.
        """
        ends = self.contigs.groupBy("asm_id").agg(F.sum("len").alias("__n"))
        r = requests.join(joins.broadcast_if_small(ends), "asm_id", "left")
        bad = F.col("__n").isNull() | (F.col("start") < 0) | (F.col("length") < 0) | (F.col("start") + F.col("length") > F.col("__n"))
        r = r.withColumn("start", F.when(bad, F.raise_error(F.concat(F.lit("window out of range: "), F.col("id").cast("string")))).otherwise(F.col("start"))).drop("__n")
        touched = r.withColumn("block_ix", joins.bins(F.col("start"), F.col("start") + F.col("length"), self.q))
        seq = F.col("seq").cast("string")
        blocks = self.blocks.select("asm_id", "block_ix", "bstart", "blen", (B.lowered(seq, F.col("lower")) if case and not tokens else seq).alias("__seq"))
        x0, x1 = F.greatest("start", "bstart"), F.least(F.col("start") + F.col("length"), F.col("bstart") + F.col("blen"))
        parts = touched.join(blocks, ["asm_id", "block_ix"])
        parts = parts.withColumn("__part", F.substring("__seq", (x0 - F.col("bstart") + 1).cast("int"), (x1 - x0).cast("int")))
        keys = requests.columns
        one = parts.where(F.col("start") + F.col("length") <= F.col("bstart") + F.col("blen")).where("start >= bstart").select(*keys, F.col("__part").alias("seq"))
        many = parts.where((F.col("start") + F.col("length") > F.col("bstart") + F.col("blen")) | (F.col("start") < F.col("bstart")))
        # the parts of a window that spans blocks meet by its id; the others, most of them, are not shuffled again
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ix", "__part"))), lambda s: s["__part"]), "")
        many = many.groupBy(*keys).agg(ordered.alias("seq"))
        none = r.where("length = 0").select(*keys, F.lit("").alias("seq"))
        out = one.union(many).union(none)
        out = out.withColumn("seq", F.when(F.col("rc"), B.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
        return out.withColumn("seq", B.tokens(F.col("seq"))) if tokens else out

    def fetch(self, requests: DataFrame, case: bool = True, tokens: bool = False) -> DataFrame:
        """``requests(id, assembly, contig, start0, length, rc)``, 0-based and half-open within one contig -> with ``seq``."""
        c = self.contigs.select("assembly", F.col("name").alias("contig"), "asm_id", F.col("len").alias("__len"), "boff")
        r = requests.join(joins.broadcast_if_small(c), ["assembly", "contig"], "left")
        label = F.concat_ws(" ", "assembly", "contig", F.col("start0").cast("string"), F.col("length").cast("string"))
        bad = (F.col("start0") < 0) | (F.col("length") < 0) | (F.col("start0") + F.col("length") > F.col("__len"))
        start = F.when(F.col("__len").isNull(), F.raise_error(F.concat(F.lit("no such contig: "), label))).when(bad, F.raise_error(F.concat(F.lit("out of the contig: "), label)))
        r = r.withColumn("start", start.otherwise(F.col("boff") + F.col("start0"))).drop("__len", "boff")
        # a request without an assembly must fail, not drop out of the joins below
        r = r.withColumn("asm_id", F.when(F.col("start").isNotNull(), F.coalesce("asm_id", F.lit(-1))))
        return self.windows(r, case, tokens).select(*requests.columns, "seq")

    def regions(self, requests: DataFrame, line: int = 60) -> DataFrame:
        """``requests(id, assembly, region)``, region ``name[:start[-end]]`` 1-based and inclusive -> ``(id, fasta)``, FASTA text."""
        name = F.regexp_extract("region", r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", 1)
        lo, hi = (F.regexp_extract("region", r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", k) for k in (2, 3))
        c = self.contigs.select("assembly", F.col("name").alias("contig"), F.col("len").alias("__len"))
        r = requests.withColumn("contig", name).join(joins.broadcast_if_small(c), ["assembly", "contig"])
        start = F.when(lo == "", F.lit(1)).otherwise(F.nullif(lo, F.lit("")).cast("long"))
        end = F.when(hi == "", F.col("__len")).otherwise(F.nullif(hi, F.lit("")).cast("long"))
        r = r.withColumn("start0", start - 1).withColumn("length", end - start + 1).withColumn("rc", F.lit(False)).drop("__len")
        out = self.fetch(r)
        return out.select("id", F.concat(F.lit(">"), "region", F.lit("\n"), B.wrapped(F.col("seq"), F.lit(line))).alias("fasta"))

    def starts(self, w: int) -> DataFrame:
        """Contigs that hold a window of ``w``: how many starts they have, and how many those before them."""
        v = self.contigs.where(F.col("len") >= w).withColumn("valid", F.col("len") - w + 1)
        by_asm = v.groupBy("asm_id").agg(F.sum("valid").alias("v")).withColumn("base", F.coalesce(F.sum("v").over(W.orderBy("asm_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        within = F.coalesce(F.sum("valid").over(W.partitionBy("asm_id").orderBy("contig_ix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        v = v.withColumn("lo", within).join(joins.broadcast_if_small(by_asm.drop("v")), "asm_id")
        return v.withColumn("lo", F.col("lo") + F.col("base")).withColumn("hi", F.col("lo") + F.col("valid")).drop("base")

    def sample_coordinates(self, n: int, w: int, seed: int = 0, rc_percent: int = 0) -> DataFrame:
        """``(id, asm_id, contig_ix, start0, start, length, rc)``: ``n`` windows, uniform over all starts in all contigs.

        A draw is a hash of (id, seed), so it is the same on any cluster: ``bases.drawn`` mod the number of starts, for any number of
        draws and starts up to some 2^50; the strand likewise.
        """
        starts = self.starts(w)
        total = starts.agg(F.coalesce(F.sum("valid"), F.lit(0))).first()[0]
        if not total:
            raise ValueError(f"no contig has {w} bases")
        ids = self.spark.range(n).withColumn("pos", B.drawn(F.col("id"), seed) % total).withColumn("rc", B.drawn(F.col("id"), seed, 1) % 100 < rc_percent)
        drawn = joins.point_join(ids, starts, [], max(1, total // 4096))
        start0 = F.col("pos") - F.col("lo")
        return drawn.select("id", "asm_id", "contig_ix", start0.alias("start0"), (F.col("boff") + start0).alias("start"), F.lit(w).cast("long").alias("length"), "rc")

    def sample(self, n: int, w: int, seed: int = 0, rc_percent: int = 0, tokens: bool = False) -> DataFrame:
        return self.windows(self.sample_coordinates(n, w, seed, rc_percent), tokens=tokens)

    def sample_variable(self, n: int, seed: int = 0, log_uniform: bool = False) -> DataFrame:
        """Requests for ``fetch``: contigs weighted by length, lengths uniform over octaves up to 2^20 (or, ``log_uniform``, 1 + floor(2^(20 u))), starts uniform.

        ``(id, assembly, contig, start0, length, rc)``, by hashes of (id, seed) like ``sample_coordinates``.
        """
        mixed = lambda k: B.drawn(F.col("id"), seed, k)
        starts = self.starts(1)
        total = starts.agg(F.coalesce(F.sum("valid"), F.lit(0))).first()[0]
        if not total:
            raise ValueError("the cohort has no bases")
        ids = self.spark.range(n).withColumn("pos", mixed(0) % total)
        drawn = joins.point_join(ids, starts, [], max(1, total // 4096))
        octave = F.element_at(F.array(*(F.lit(2**k).cast("long") for k in range(20))), (mixed(1) % 20 + 1).cast("int"))
        size = 1 + F.floor(F.pow(F.lit(2.0), 20.0 * (mixed(1) / F.lit(2.0**60)))) if log_uniform else octave + mixed(2) % octave
        drawn = drawn.withColumn("length", F.least(F.col("len"), size))
        start0 = mixed(3) % (F.col("len") - F.col("length") + 1)
        return drawn.select("id", "assembly", F.col("name").alias("contig"), start0.alias("start0"), "length", (mixed(4) % 2 == 1).alias("rc"))

    def contig_of(self, points: DataFrame) -> DataFrame:
        """``points(.., asm_id, pos)`` on the streams -> with ``contig_ix`` and ``start0`` in the contig."""
        spans = self.contigs.select("asm_id", "contig_ix", F.col("boff").alias("lo"), (F.col("boff") + F.col("len")).alias("hi"))
        return joins.point_join(points, spans, ["asm_id"], 4 * self.q).select(*points.columns, "contig_ix", (F.col("pos") - F.col("lo")).alias("start0"))

    # ---- whole assemblies

    def decode(self, case: bool = True) -> DataFrame:
        """``(asm_id, block_ix, bstart, seq)``: the streams, block by block; sort by key where order matters."""
        seq = F.col("seq").cast("string")
        return self.blocks.select("asm_id", "block_ix", "bstart", (B.lowered(seq, F.col("lower")) if case else seq).alias("seq"))

    def contig_sequences(self) -> DataFrame:
        """``(asm_id, contig_ix, name, header, line_width, seq)``: contigs put together from their blocks, with case."""
        whole = self.contigs.select(F.col("name").alias("id"), "asm_id", F.col("boff").alias("start"), F.col("len").alias("length"), F.lit(False).alias("rc"), "contig_ix", "header", "line_width")
        return self.windows(whole).select("asm_id", "contig_ix", F.col("id").alias("name"), "header", "line_width", "seq")

    def fasta_records(self) -> DataFrame:
        """``(asm_id, contig_ix, record)``: each contig's FASTA text, header and lines as they came in."""
        rows = self.contig_sequences()
        return rows.select("asm_id", "contig_ix", F.concat(F.lit(">"), "header", F.lit("\n"), B.wrapped(F.col("seq"), F.col("line_width"))).alias("record"))

    def contig_parts(self, case: bool = True) -> DataFrame:
        """``(asm_id, contig_ix, at, part)``: contigs in parts of a block at most, from place ``at`` of the contig on; an empty contig has none."""
        c = self.contigs.select("asm_id", "contig_ix", "boff", "len").withColumn("block_ix", joins.bins(F.col("boff"), F.col("boff") + F.col("len"), self.q))
        both = self.decode(case).join(c, ["asm_id", "block_ix"])
        x0, x1 = F.greatest("boff", "bstart"), F.least(F.col("boff") + F.col("len"), F.col("bstart") + F.length("seq"))
        return both.select("asm_id", "contig_ix", (x0 - F.col("boff")).alias("at"), F.substring("seq", (x0 - F.col("bstart") + 1).cast("int"), (x1 - x0).cast("int")).alias("part"))

    def fasta_parts(self) -> DataFrame:
        """``(asm_id, contig_ix, at, text)``: each contig's FASTA text in parts, the header at -1, line ends where they belong."""
        c = self.contigs.select("asm_id", "contig_ix", "header", "len", F.greatest("line_width", F.lit(1)).alias("width"))
        head = c.select("asm_id", "contig_ix", F.lit(-1).cast("long").alias("at"), F.concat(F.lit(">"), "header", F.lit("\n")).alias("text"))
        rows = self.contig_parts().join(joins.broadcast_if_small(c.drop("header")), ["asm_id", "contig_ix"])
        # what the line that is open at the part's start still takes, then whole lines, then the beginning of the next one
        rows = rows.withColumn("left", F.least(F.pmod(-F.col("at"), F.col("width")), F.length("part")).cast("int"))
        end = F.col("at") + F.length("part")
        mark = lambda here: F.when(here, F.lit("\n")).otherwise(F.lit(""))
        lines = F.regexp_replace(F.expr("substring(part, left + 1)"), F.concat(F.lit("(?s).{"), F.col("width").cast("string"), F.lit("}")), F.lit("$0\n"))
        first = F.concat(F.expr("substring(part, 1, left)"), mark((F.col("left") > 0) & ((F.col("at") + F.col("left")) % F.col("width") == 0)))
        text = F.concat(first, lines, mark((end == F.col("len")) & (end % F.col("width") != 0)))
        return head.union(rows.select("asm_id", "contig_ix", "at", text.alias("text")))

    def fasta_lines(self) -> DataFrame:
        """``(asm_id, contig_ix, at, text)``: headers at -1 and, for each block's part of a contig, the lines that begin in it, without the last line end.

        A line that goes on into the next part is put together by its place: a part hands its first bases to the part where that line begins.
        """
        c = self.contigs.select("asm_id", "contig_ix", "boff", "len", F.greatest("line_width", F.lit(1)).cast("long").alias("width"))
        rows = self.contig_parts().join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"])
        left = F.least(F.pmod(-F.col("at"), F.col("width")), F.length("part")).cast("int")
        rows = rows.withColumn("left", left)
        part = lambda lo, n, at: F.struct(F.expr(f"substring(part, {lo}, {n})").alias("bases"), at.alias("pos"))
        two = F.array(part("1", "left", F.col("at")), part("left + 1", "length(part)", F.col("at") + F.col("left")))
        rows = rows.select("asm_id", "contig_ix", "boff", "width", F.explode(two).alias("p")).where("length(p.bases) > 0")
        line = F.col("p.pos") - F.pmod(F.col("p.pos"), F.col("width"))
        block = F.floor((F.col("boff") + line) / self.q)
        rows = rows.select("asm_id", "contig_ix", "width", block.alias("block"), F.col("p.pos").alias("pos"), F.col("p.bases").alias("bases"))
        rows = rows.groupBy("asm_id", "contig_ix", "width", "block").agg(F.min("pos").alias("at"), _joined("pos", "bases").alias("bases"))
        lines = rows.select("asm_id", "contig_ix", "at", B.wrapped(F.col("bases"), F.col("width")).alias("text")).withColumn("text", F.expr("substring(text, 1, length(text) - 1)"))
        head = self.contigs.select("asm_id", "contig_ix", F.lit(-1).cast("long").alias("at"), F.concat(F.lit(">"), "header").alias("text"))
        return head.union(lines)

    def write_fasta(self, path: str) -> None:
        """A folder for each assembly with its records in order, its files' order being that of their names. No row is longer than a block
        and a line, so a contig is written by as many tasks as its size asks for."""
        rows = self.fasta_lines().join(joins.broadcast_if_small(self.names()), "asm_id")
        rows = rows.repartitionByRange("assembly", "contig_ix", "at").sortWithinPartitions("assembly", "contig_ix", "at")
        rows.select("assembly", F.col("text").alias("value")).write.partitionBy("assembly").text(path)

    def fasta_digests(self) -> DataFrame:
        """``(asm_id, contig_ix, n, sha256)`` of every record's FASTA text."""
        return fold.sha256_in_order(self.fasta_parts(), ["asm_id", "contig_ix"], "at", "text")

    def check_full(self) -> DataFrame:
        """``(asm_id, contig_ix, len, sha256)`` of every contig's bases, case kept, and whether their number is the table's."""
        none = self.contigs.where("len = 0").select("asm_id", "contig_ix", F.lit(0).cast("long").alias("at"), F.lit("").alias("part"))
        rows = fold.sha256_in_order(self.contig_parts().union(none), ["asm_id", "contig_ix"], "at", "part")
        rows = self.contigs.select("asm_id", "contig_ix", "len").join(rows, ["asm_id", "contig_ix"], "left")
        return rows.select("asm_id", "contig_ix", "len", "sha256", F.coalesce(F.col("n") == F.col("len"), F.lit(False)).alias("complete"))

    def tiles(self, w: int) -> DataFrame:
        """``(asm_id, contig_ix, start0)``: windows of ``w`` end to end in every contig."""
        last = (F.col("len") - w).cast("long")
        return self.contigs.where(F.col("len") >= w).select("asm_id", "contig_ix", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(w).cast("long"))).alias("start0"), "boff")
