"""WARC archives with a two-level capture index.

Writing: each page becomes a record, ``response`` with its HTTP block and payload, or ``revisit`` whose HTTP head states the
length of the payload and which names the page that has it. Spark's text writer lays the records end to end (the blank lines
that end a record are its line separator), so the archives are plain WARC/1.1 files on any file system that Spark writes to.

Index: one line for each record, keyed by the URL with its host reversed, sorted by range over all partitions and cut into
compressed blocks of lines. The sparse directory is a table of its own: a block's number, first and last key. A lookup bisects
the directory, reads the few blocks that it names, bisects their lines, and reads each record's bytes by offset and length.

Reading everything takes the same way from the blocks on: their lines are dealt by file and offset, and every task reads its
ranges, in order, from the archives, which are never shuffled nor loaded whole. Executors open them with ``pyarrow.fs``
(local or mounted folders, hdfs, s3 and s3a, gs, abfs). On any other file system Spark's own reader brings each archive to the task
that cuts its ranges, one file of ``FILE_RECORDS`` records at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import text as tx
from strandlake.scratch import Scratch, new_path

END = "\r\n\r\n"
#: Records of an archive file, index lines of a block, bytes read at a time.
FILE_RECORDS, BLOCK_LINES, CHUNK = 1000, 512, 2**22
#: Repeated payloads (52 bytes and a URL each) that are sent to every executor; more are joined by a shuffle.
REPEATS = 200_000
#: Blocks whose directory the driver holds for lookups; a larger one is searched where it lies.
DIRECTORY = 1_000_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def reversed_host_key(url: str | None) -> str:
    """``https://a.b.com:80/x?y`` -> ``com,b,a:80)/x?y``, in lower case up to the path; no fragment."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return ")" + url
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _text(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in tx.binaries(column)]


def _uri(url: str | None) -> str:
    return re.sub(r"[\s<>\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        space = uuid.uuid5(uuid.NAMESPACE_OID, f"{task.partitionId()} {uuid.uuid4()}")
        for b in batches:
            out = []
            pages, firsts = b.column(0).to_pylist(), b.column(4).to_pylist()
            for page, url, payload, sha, first, there in zip(pages, _text(b.column(1)), tx.binaries(b.column(2)), b.column(3).to_pylist(), firsts, _text(b.column(5)), strict=True):
                payload, n = payload or b"", n + 1
                full = page is None or page == first or first is None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
                block = http + payload if full else http
                lines = ["WARC/1.1", f"WARC-Type: {'response' if full else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(space, str(n))}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"]
                if page is not None:
                    lines.append(f"X-Page-ID: {page}")
                if not full:
                    lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To-Target-URI: {_uri(there)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {first}"]
                lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                out.append(("\r\n".join(lines) + END).encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def head_of(data: bytes) -> dict[str, str]:
    """The named fields of a record's head."""
    lines = data.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    return dict(line.split(": ", 1) for line in lines[1:])


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Of one whole record: its fields, the length of the full payload, and the payload that it holds, empty for a revisit."""
    head = data.index(b"\r\n\r\n")
    headers = head_of(data[:head])
    end = head + 4 + int(headers["Content-Length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError("the record does not end where it says")
    http, payload = data[head + 4 : end].split(b"\r\n\r\n", 1)
    return headers, int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), payload


def _arrow_opens(path: str) -> bool:
    """Is this a file system that executors can open with Arrow?"""
    return re.match("[a-z0-9]*", path.lower())[0] in ("file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss") or ":/" not in path


def _opened(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))
    return system.open_input_file(name)


class Reader:
    """Byte ranges of files, asked for in order: what stands behind one is read with it and kept for the next. Or of a file's bytes, if they are given."""

    def __init__(self, path: str | None = None, data: bytes = b"") -> None:
        self.path, self.file, self.at, self.data = path, None, 0, data

    def get(self, path: str, at: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, _opened(path)
        if at < self.at or at + length > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(length, CHUNK), at)
        return self.data[at - self.at : at - self.at + length]

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.path, self.file, self.at, self.data = None, None, 0, b""


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index lines of archives, from the records' heads."""
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    for b in batches:
        whole = b.column(2).to_pylist() if b.num_columns > 2 else [None] * len(b)
        for path, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), whole, strict=True):
            reader, at, out = Reader() if data is None else Reader(path, data), 0, []
            while at < size:
                some = 1024
                while (end := (data := reader.get(path, at, min(some, size - at))).find(b"\r\n\r\n")) < 0:
                    if at + some >= size:
                        raise ValueError(f"no whole record at byte {at} of {path}")
                    some *= 4
                headers = head_of(data[:end])
                length = end + 8 + int(headers["Content-Length"])
                page = headers.get("X-Page-ID")
                out.append((reversed_host_key(headers["WARC-Target-URI"]), int(page) if page else None, path, at, length))
                at += length
            reader.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "page_id", "file", "at", "length"])


def _line(key: str, page: int | None, file: str, at: int, length: int) -> str:
    return f"{key}\t{'' if page is None else page}\t{file}\t{at}\t{length}"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines: list[str] = []
    number = TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        data = zlib.compress("\n".join(lines).encode())
        first, last = lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([first]), pa.array([last]), pa.array([len(lines)], pa.int32()), pa.array([data], pa.binary())], ["block", "first_key", "last_key", "lines", "data"])

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            lines.append(_line(*row))
            if len(lines) == BLOCK_LINES:
                yield flush()
                lines.clear()
                number += 1
    if lines:
        yield flush()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column(0).to_pylist():
            rows = [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64())], ["file", "at", "length"])


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(path: str, at: int, data: bytes) -> tuple:
    headers, size, payload = parse(data)
    page, refers, sha = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID"), headers["WARC-Payload-Digest"][5:]
    if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError(f"the payload at byte {at} of {path} isn't the one that was written")
    return int(page) if page else None, headers["WARC-Target-URI"], size, sha, headers["WARC-Type"], int(refers) if refers else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in RECORD.split(", ")])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at the given places, sorted by file and offset."""
    reader = Reader()
    for b in batches:
        yield _batch([_record(path, at, reader.get(path, at, length)) for path, at, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)])
    reader.close()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records at the places that stand beside each archive's bytes."""
    for b in batches:
        for path, places, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield _batch([_record(path, x["at"], data[x["at"] : x["at"] + x["length"]]) for x in places])


@dataclass
class Archive:
    """A folder of archives and its index: ``blocks(block, first_key, last_key, lines, data)`` in key order, numbered in that
    order, and the sparse ``directory(block, first_key, last_key, lines)``."""

    path: str
    blocks: DataFrame
    directory: DataFrame
    _held: list | None = field(default=None, repr=False)

    def records(self) -> DataFrame:
        """Every record, read by the index's ranges: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``.

        A response's payload is held against its length and digest; a revisit states those of its response.
        """
        wanted = self.blocks.select("data").mapInArrow(_unpacked, "file string, at long, length long")
        if not _arrow_opens(self.path):
            files = self.blocks.sparkSession.read.format("binaryFile").load(self.path).select(F.col("path").alias("file"), "content")
            places = wanted.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("places"))  # FILE_RECORDS places at most
            return places.join(files, "file").select("file", "places", "content").mapInArrow(_slices, RECORD)
        wanted = wanted.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
        return wanted.mapInArrow(_ranges, RECORD)

    def blocks_of(self, key: str) -> list[int]:
        """The blocks that may hold a key, by bisection of the directory."""
        if self._held is None and self.directory.count() <= DIRECTORY:
            rows = self.directory.orderBy("block").collect()
            self._held = [[r.first_key for r in rows], [r.last_key for r in rows], [r.block for r in rows]]
        if self._held is None:
            return [r.block for r in self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("block").collect()]
        firsts, lasts, numbers = self._held
        return numbers[bisect.bisect_left(lasts, key) : bisect.bisect_right(firsts, key)]

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """The records of a URL, on the driver: the directory, then its blocks, then the bytes of each record."""
        spark, key = self.blocks.sparkSession, reversed_host_key(_uri(url))  # as it was written
        near = self.blocks_of(key)
        out = []
        for row in self.blocks.where(F.col("block").isin(near)).select("data").toLocalIterator() if near else ():
            lines = zlib.decompress(bytes(row.data)).decode().split("\n")
            keys = [x.split("\t", 1)[0] for x in lines]
            for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                _, _, file, at, length = line.split("\t")
                headers, _, payload = parse(read_range(spark, file, int(at), int(length)))
                out.append((headers, payload))
        return out


def read_range(spark: SparkSession, file: str, at: int, length: int) -> bytes:
    """Bytes of a file on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(at)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def write(pages: DataFrame, date: str = DATE) -> Archive:
    """Write ``pages(page_id, url, html, ...)`` as WARC archives in the shared folder and index them.

    Of records with equal payloads the one with the smallest page_id is the response; the others are revisits. A null html is
    an empty payload and a null url ``about:blank``. Rows with a null page_id, and all rows that repeat the smallest one, are
    responses. Payloads are taken byte by byte, whether they are UTF-8 or not and however long; a url's other bytes become
    U+FFFD. An empty table gives an archive without records. Other columns are not looked at. ``date`` is every record's.
    """
    spark = pages.sparkSession
    tx.small_batches(spark)
    scratch = Scratch(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    repeated = rows.groupBy("sha").agg(least.alias("x"), F.count("*").alias("n")).where("n > 1 and x is not null")
    repeated = scratch.save(repeated.select(F.col("sha").alias("s"), F.col("x.page_id").alias("first"), F.col("x.url").alias("there"), "n"), "repeated")
    path = new_path(spark, "warc")
    columns = ["page_id", "url", "html", "sha", "first", "there"]
    values = _joined(rows, repeated).select(*columns).mapInArrow(_records(date), "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    files = spark.read.format("binaryFile").load(path).select("path", "length", *([] if _arrow_opens(path) else ["content"]))
    entries = scratch.save(files.mapInArrow(_entries, "key string, page_id long, file string, at long, length long"), "entries")
    ordered = entries.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    blocks = scratch.save(ordered.mapInArrow(_blocks, "block long, first_key string, last_key string, lines int, data binary"), "blocks")
    return Archive(path, blocks, scratch.save(blocks.drop("data"), "directory"))


def _joined(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``there`` of ``repeated(s, first, there, n)``; the payloads are shuffled only if that is large."""
    same = F.col("sha") == F.col("s")
    if repeated.count() <= REPEATS:
        return rows.join(F.broadcast(repeated), same, "left")
    # a payload that would fill more than an even share of the tasks is one of fewer than there are tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = repeated.agg(F.sum("n")).first()[0]
    hot = repeated.where(F.col("n") * tasks > total)
    rest = rows.join(F.broadcast(hot.select("s")), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(rest.join(repeated, same, "left"))
