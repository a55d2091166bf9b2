"""FASTA files read in splits by many tasks: bases in pieces, an index of the records, and a data source that reads regions by it.

``scan_fasta`` reads with Spark's text reader, which cuts files at line ends and opens every file system that Spark knows. A task turns
each batch of lines into a piece for every record that it touches; where a piece stands in its record follows from the lengths of
those before it, which are summed over a narrow table, without the bases.

``spark.read.format("strandlake_fasta")`` reads pieces by an index that ``write_index`` stored: places in a file follow from a record's offset and line width, so a
task reads only its byte range, and filters on assembly, name and place leave out whatever can't match before a byte is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan

from strandlake.operators import joins
from strandlake.scratch import Scratch

_PIECE = "path string, block long, n int, header string, lines long, widest int, last int, seq binary, lower array<struct<from:int,n:int>>"


def _lower_runs(x: np.ndarray) -> list[dict[str, int]]:
    low = np.concatenate(([False], (x >= 97) & (x <= 122), [False]))
    edges = np.flatnonzero(low[1:] != low[:-1])
    return [{"from": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order, by split, into pieces: a batch's lines up to the next header or split."""
    at: tuple[str, int] | None = None
    n = 0
    for b in batches:
        lines, path, block = b.column(0), b.column(1), b.column(2)
        heads = pc.starts_with(lines, ">").to_numpy(zero_copy_only=False)
        p, k = path.dictionary_encode().indices.to_numpy(), block.to_numpy()
        cuts = heads.copy()
        cuts[1:] |= (p[1:] != p[:-1]) | (k[1:] != k[:-1])
        edges = [0, *(i for i in np.flatnonzero(cuts).tolist() if i), len(lines)]
        rows = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = (path[lo].as_py(), block[lo].as_py())
            n = 0 if here != at else n + 1
            at = here
            header = lines[lo].as_py()[1:] if heads[lo] else None
            own = lines[lo + int(heads[lo]) : hi].cast(pa.large_binary())
            size = pc.binary_length(own).to_numpy()
            # the values lie end to end in one buffer, so the bases of all lines are one slice of it
            ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(2, np.int64)
            bases = bytes(own.buffers()[2][int(ends[0]) : int(ends[-1])]) if len(own) and ends[-1] > ends[0] else b""
            rows.append((*here, n, header, len(own), int(size.max()) if len(own) else 0, int(size[-1]) if len(own) else 0, bases.upper(), _lower_runs(np.frombuffer(bases, np.uint8))))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("from", pa.int32()), ("n", pa.int32())])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["path", "block", "n", "header", "lines", "widest", "last", "seq", "lower"])


@dataclass
class Scan:
    """``records(assembly, order, header, len, line_width, path, offset)``, ``pieces(assembly, order, start, seq)``, ``case_runs(assembly, start, len)``."""

    records: DataFrame
    pieces: DataFrame
    case_runs: DataFrame


def scan_fasta(spark: SparkSession, path: str, glob: str = "*.fa*", folders: bool = False) -> Scan:
    """A folder with a FASTA file for each assembly, plain or gzip, of any length, read split by split (gzip: a task a file, in pieces too).

    With ``folders`` every subfolder ``assembly=NAME`` is an assembly, its files in order of names one stream: what ``Cohort.write_fasta`` writes.
    ``Cohort.from_pieces`` builds a cohort of it. Bases come in upper case, their case as runs over an assembly's stream.

    Strict as ``fasta.parse``: a record's lines have one width but for a shorter last one, none is empty, a file begins with a header (with ``folders`` an
    assembly) and plain files end with a line end; anything else is an error where records are used. A line must be under 2 GB.
    """
    scratch = Scratch(spark)
    text = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_metadata.file_size")
    raw = scratch.save(text.select("value", meta[0].alias("path"), meta[1].alias("block")).mapInArrow(_pieces, _PIECE), "lines")
    sizes = text.select(meta[0].alias("path"), meta[2].alias("size")).distinct()
    name = F.regexp_extract("path", r"assembly=([^/]*)/[^/]*$", 1) if folders else F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.f(ast)?a(\.gz)?$", "")
    raw = raw.withColumn("assembly", F.url_decode(name))

    # what follows reads no bases: a row a piece, numbered and summed in its assembly
    narrow = raw.select("assembly", "path", "block", "n", "header", "lines", "widest", "last", F.length("seq").cast("long").alias("size"))
    by = W.partitionBy("assembly").orderBy("path", "block", "n")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    narrow = narrow.withColumn("order", F.sum(F.col("header").isNotNull().cast("long")).over(upto) - 1).withColumn("to", F.sum("size").over(upto))
    # bytes before a piece's first base in its file: all bases and line ends, and headers with their two bytes
    taken = F.col("size") + F.col("lines") + F.coalesce(F.octet_length("header") + 2, F.lit(0))
    narrow = narrow.withColumn("file_to", F.sum(taken).over(W.partitionBy("path").orderBy("block", "n").rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy("assembly", "order")
    narrow = narrow.withColumn("start", F.col("to") - F.col("size") - F.min(F.col("to") - F.col("size")).over(within))
    narrow = scratch.save(narrow.withColumn("offset", F.col("file_to") - F.col("size") - F.col("lines")), "places")

    files = narrow.groupBy("path").agg(F.max("file_to").alias("bytes")).join(sizes, "path")
    short = files.where(~F.col("path").endswith(".gz") & (F.col("bytes") > F.col("size"))).select("path").collect()  # a row a broken file
    if short:
        raise ValueError(f"{short[0].path}: no final line end")
    order = F.struct("path", "block", "n")
    rows = narrow.groupBy("assembly", "order").agg(
        F.max("header").alias("header"), F.sum("size").alias("len"), F.max("widest").alias("line_width"), F.sum("lines").alias("lines"),
        F.max(F.when(F.col("lines") > 0, F.struct(order.alias("at"), F.col("last")))).alias("end"), F.min_by("path", order).alias("path"), F.min_by("offset", order).alias("offset"),
    )
    w, last = F.col("line_width"), F.col("end.last")
    regular = (F.col("lines") == 0) | ((last > 0) & (F.col("len") == (F.col("lines") - 1) * w + last))
    label = F.concat(F.col("assembly"), F.lit(": "), F.coalesce("header", F.lit("")))
    width = F.when(F.col("order") < 0, F.raise_error(F.concat(F.lit("no header at byte 0: "), label)).cast("int")).when(~regular, F.raise_error(F.concat(F.lit("irregular line layout: "), label)).cast("int")).otherwise(w)
    records = scratch.save(rows.select("assembly", "order", "header", "len", width.alias("line_width"), "path", "offset"), "records")

    places = narrow.select("path", "block", "n", "order", "start")
    own = raw.join(joins.broadcast_if_small(places), ["path", "block", "n"])
    pieces = own.where(F.length("seq") > 0).select("assembly", "order", "start", "seq")
    by = W.partitionBy("assembly").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    boff = records.select("assembly", "order", F.coalesce(F.sum("len").over(by), F.lit(0)).alias("boff"))
    runs = own.select("assembly", "order", "start", F.explode("lower").alias("r"))
    runs = runs.select("assembly", "order", (F.col("start") + F.col("r.from")).alias("lo"), (F.col("start") + F.col("r.from") + F.col("r.n")).alias("hi"))
    # a run that goes on in the next piece is one
    runs = joins.merged(runs, ["assembly", "order"]).join(joins.broadcast_if_small(boff), ["assembly", "order"])
    return Scan(records, pieces, runs.select("assembly", (F.col("boff") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo")).alias("len")))


# ---------------------------------------------------------------- by index


def write_index(scan: Scan, path: str) -> None:
    """The records as one JSON line each, by assembly and order: what the data source reads. Records whose file isn't plain can't be read by it."""
    rows = scan.records.where(~F.col("path").endswith(".gz")).withColumn("name", F.regexp_extract("header", r"^[^ \t]*", 0))
    rows.repartitionByRange("assembly", "order").sortWithinPartitions("assembly", "order").write.json(path)


@dataclass
class _Range(InputPartition):
    """Stretches of records: ``(file, offset, line width, assembly, order, name, record's length, from, to)`` each."""

    parts: list[tuple[str, int, int, str, int, str, int, int, int]]


class FastaSource(DataSource):
    """Options: ``path`` (the index's folder), ``piece`` (bases a row, 65,536 unless given), ``split`` (bases a task, 32 million)."""

    @classmethod
    def name(cls) -> str:
        return "strandlake_fasta"

    def schema(self) -> str:
        return "assembly string, order long, name string, start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _opened(url: str):
    """A readable, seekable file of a local path or of a store that Arrow knows."""
    from pyarrow import fs

    if url.startswith("file:"):
        return open(re.sub("^file:/*", "/", url), "rb")
    url = re.sub("^s3[an]://", "s3://", url)
    where, path = fs.FileSystem.from_uri(url)
    return where.open_input_file(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.piece, self.split = options["path"], int(options.get("piece", 65536)), int(options.get("split", 2**25))
        self.equal: dict[str, set] = {}
        self.lo, self.hi = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Assemblies, names and orders by equality or list are decided here; places only leave out pieces, and Spark looks again."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("assembly", "name", "order"):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[column] = self.equal.get(column, own) & own
                continue
            if isinstance(f, GreaterThanOrEqual) and column == "start":
                self.lo = max(self.lo, f.value)
            if isinstance(f, LessThan) and column == "start":
                self.hi = f.value if self.hi is None else min(self.hi, f.value)
            yield f

    def _index(self) -> Iterator[dict]:
        """The index's lines, one after the other: metadata, a line a record."""
        from pyarrow import fs

        url = re.sub("^s3[an]://", "s3://", self.path)
        where, folder = (fs.LocalFileSystem(), re.sub("^file:/*", "/", url)) if "://" not in url or url.startswith("file:") else fs.FileSystem.from_uri(url)
        for info in sorted(where.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            if info.path.rsplit("/", 1)[-1].startswith("part-"):
                with where.open_input_stream(info.path) as f:
                    for line in f.read().splitlines():
                        yield json.loads(line)

    def partitions(self) -> list[InputPartition]:
        """Of ``split`` bases each: long records are cut, short ones go together, so tasks grow with bases, not with records."""
        out: list[InputPartition] = []
        parts, held = [], 0
        step = max(1, self.split // self.piece) * self.piece
        first = -(-self.lo // self.piece) * self.piece
        for r in self._index():
            if any(r[c] not in some for c, some in self.equal.items()):
                continue
            end = r["len"] if self.hi is None else min(r["len"], self.hi)
            for lo in range(first, end, step):
                to = min(end, lo + step)
                if parts and held + to - lo > step:
                    out.append(_Range(parts))
                    parts, held = [], 0
                parts.append((r["path"], r["offset"], r["line_width"], r["assembly"], r["order"], r["name"], r["len"], lo, to))
                held += to - lo
        return [*out, _Range(parts)] if parts else out

    def read(self, partition: _Range) -> Iterator[tuple]:
        f, opened = None, None
        try:
            for file, offset, w, assembly, order, name, size, lo, to in partition.parts:
                if file != opened:
                    if f:
                        f.close()
                    f, opened = _opened(file), file
                for start in range(lo, to, self.piece):
                    f.seek(offset + start + start // w)
                    last = min(start + self.piece, size) - 1
                    data = f.read(last + last // w - start - start // w + 1)
                    yield assembly, order, name, start, data.replace(b"\n", b"").upper().decode()
        finally:
            if f:
                f.close()


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand Python sources its filters, without which this one can't be read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
