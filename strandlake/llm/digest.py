"""Fingerprints of texts: quartile bucket digests, near for texts that are nearly equal, and the next document of each in order of ids.

From every five neighbouring bytes six triplets are taken, each hashed by tables to one of 256 buckets. A bucket's count is put down as
the quartile of the counts that it lies in, two bits each; before them stand the text's length in steps of its logarithm and two ratios of
the quartiles. So the digest is 66 bytes whatever the text, and a small edit moves few buckets.

Two digests' difference is the sum over buckets of how far the quartiles are apart (0, 1, 2 or 6), as a share of what it could be at most for
these two, and small bounded shares for length and ratios, held against ``LIMIT``; likeness is one less that, 0 at least.

Documents are dealt and sorted by id once. Each task hands every document the head of its next one; of the last of a task only
that text and the first of the next task meet in a join, so a task's neighbours cost two texts each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text as tx
from strandlake.scratch import Scratch

BUCKETS = 256
#: Offsets of a triplet's bytes from the first one.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
SPAN = 5
#: What a bucket counts whose quartiles are 0 to 3 apart.
APART = np.array([0, 1, 2, 6])
#: Steps of the length's logarithm, and what lengths and ratios that differ by more than one step add for each further one, and at most.
STEP, PER_STEP, AT_MOST = 1.3, 0.02, 0.1
#: The share from which digests count as wholly different: prose of one language that has nothing else in common is 0.4 to 0.5 apart.
LIMIT = 0.7
#: Bytes that are counted together.
TOGETHER = 2**21


def _tables() -> np.ndarray:
    """For each place in a triplet and byte, the first byte of md5 of ``place:byte``; a triplet's bucket is their exclusive or."""
    return np.array([[hashlib.md5(f"{p}:{b}".encode()).digest()[0] for b in range(256)] for p in range(3)], np.uint8)


def counts(texts: list[bytes]) -> np.ndarray:
    """How many triplets of each text fall into each bucket, a row a text."""
    out, tables, begin = np.zeros((len(texts), BUCKETS), np.int64), _tables(), 0
    sizes = np.array([len(t) for t in texts], np.int64)
    upto = np.cumsum(sizes)
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + TOGETHER, "right")))
        x = np.frombuffer(b"".join(texts[begin:end]), np.uint8)
        rows = np.repeat(np.arange(end - begin, dtype=np.int64) * BUCKETS, sizes[begin:end])
        a, b, c = (t[x] for t in tables)
        total = np.zeros((end - begin) * BUCKETS, np.int64)
        for i, (_, j, k) in enumerate(TRIPLETS):
            m = len(x) - k
            if m > 0:
                bucket = a[:m] ^ b[j : j + m] ^ c[k:]
                own = rows[:m] == rows[k:]  # not across two texts
                total += np.bincount((rows[:m] + np.roll(np.arange(BUCKETS), -37 * i)[bucket])[own], minlength=len(total))
        out[begin:end] = total.reshape(-1, BUCKETS)
        begin = end
    return out


class Digests:
    """Digests of many texts: ``head`` (length step, ratios of the quartiles) and ``body`` (a quartile a bucket), a row each."""

    def __init__(self, head: np.ndarray, body: np.ndarray):
        self.head, self.body = head, body

    @classmethod
    def of(cls, counted: np.ndarray, sizes: np.ndarray) -> Digests:
        ranked = np.sort(counted, axis=1)
        q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        body = (counted[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
        # the small term keeps whole steps whole, however the logarithm is rounded
        length = np.floor(np.log(sizes + 1.0) / np.log(STEP) + 1e-9).astype(np.int64)
        ratios = 15 * q[:, :2] // np.maximum(q[:, 2:], 1)
        return cls(np.concatenate([np.minimum(length, 255)[:, None], ratios], 1), body)

    def __getitem__(self, at: slice | np.ndarray) -> Digests:
        return Digests(self.head[at], self.body[at])

    def hex(self) -> list[str]:
        packed = (self.body.reshape(len(self.body), -1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(2).astype(np.uint8)
        return [f"{h[0]:02x}{h[1]:x}{h[2]:x}{bytes(b).hex()}" for h, b in zip(self.head.tolist(), packed, strict=True)]

    @classmethod
    def parse(cls, values: list[str]) -> Digests:
        packed = np.array([np.frombuffer(bytes.fromhex(v[4:]), np.uint8) for v in values], np.uint8).reshape(-1, BUCKETS // 4)
        body = (packed[:, :, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1, BUCKETS)
        return cls(np.array([[int(v[:2], 16), int(v[2], 16), int(v[3], 16)] for v in values], np.int64).reshape(-1, 3), body)


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """One less the bounded difference: 1 for equal digests, 0 at least."""
    x, y = a.body.astype(np.int64), b.body.astype(np.int64)
    far = APART[np.abs(x - y)].sum(1) / np.maximum(APART[np.maximum(x, y)].sum(1), 1)
    further = np.maximum(np.abs(a.head - b.head) - 1, 0)
    return np.clip(1 - (far + np.minimum(PER_STEP * further, AT_MOST).sum(1)) / LIMIT, 0, 1)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _digested(texts: list[bytes]) -> tuple[np.ndarray, Digests]:
    counted = counts(texts)
    return counted, Digests.of(counted, np.array([len(t) for t in texts], np.int64))


def _against(ids: list, texts: list[str], heads: list[str], counted: np.ndarray, own: Digests, following: Digests) -> list[pa.Array]:
    """The columns of OUT for texts whose next documents are ``heads`` (or begin so)."""
    sizes = [len(t) for t in texts]
    cut = [n - n // 4 for n in sizes]
    new = [h[: n // 4].encode() for h, n in zip(heads, sizes, strict=True)]
    stays = [t[:c].encode() for t, c in zip(texts, cut, strict=True)]
    gone = [t[c:].encode() for t, c in zip(texts, cut, strict=True)]
    # triplets that touch the cut or lie behind it change; those that lie before it are counted already
    last = [s[-(SPAN - 1) :] for s in stays]
    changed = counted - counts([a + b for a, b in zip(last, gone, strict=True)]) + counts([a + b for a, b in zip(last, new, strict=True)])
    edited = Digests.of(changed, np.array([len(a) + len(b) for a, b in zip(stays, new, strict=True)], np.int64))
    sha = [hashlib.sha256(a + b).hexdigest() for a, b in zip(stays, new, strict=True)]
    return [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sha), pa.array(own.hex()), pa.array(edited.hex()), pa.array(likeness(own, edited)), pa.array(likeness(own, following))]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents in order: a row each but the last (kind 0), and the first (1) and the last (2) with their texts."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def rows(kind: int, columns: list[pa.Array], texts: list | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), *columns, pa.array(texts or [None] * n, pa.string())], ["part", "kind", *_NAMES, "text"])

    def edge(kind: int, i: int | None, text: str, digest: Digests) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.float64(), pa.float64())]
        return rows(kind, [pa.array([i], pa.int64()), pa.array([len(text)], pa.int64()), none[0], pa.array(digest.hex()), *none[1:]], [text])

    ids, texts, started = [], [], False
    for b in batches:
        ids, texts = ids + b.column(0).to_pylist(), texts + [t or "" for t in b.column(1).to_pylist()]
        if not ids:
            continue
        counted, own = _digested([t.encode() for t in texts])
        if not started:
            started = True
            yield edge(1, ids[0], texts[0], own[:1])
        if len(ids) > 1:
            yield rows(0, _against(ids[:-1], texts[:-1], texts[1:], counted[:-1], own[:-1], own[1:]))
        ids, texts = ids[-1:], texts[-1:]
    if ids:
        yield edge(2, ids[0], texts[0], _digested([texts[0].encode()])[1])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, heads, following = (b.column(i).to_pylist() for i in range(4))
        counted, own = _digested([t.encode() for t in texts])
        yield pa.RecordBatch.from_arrays(_against(ids, texts, heads, counted, own, Digests.parse(following)), _NAMES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row for each row.

    ``edited`` is the text whose last floor(n_chars / 4) code points are replaced by as many first ones of the next document (all of it, if
    it is shorter): the next in order of doc_id, nulls last, equal ids in order of their texts' md5; after the last comes the first. ``near_edited`` and ``near_next`` are the
    likeness of the text's digest to those of the edited text and of the next document.

    A null text counts as empty; an empty text has all buckets 0, likeness 1 to another such text and 0 to others. Equal texts have equal digests. Texts are read whole, however
    long. Repeated rows are documents each, and one document alone is its own next. An empty table gives an empty result. Other columns aren't looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    tx.small_batches(spark)
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("m")]
    # rows that agree in id and text are told apart by where they are read, so that no one task gets all of them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("m"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = scratch.save(rows.mapInArrow(_in_order, f"part int, kind int, {OUT}, text string"), "digests")
    heads = found.where("kind = 1").select("part", F.col("text").alias("head"), F.col("fingerprint").alias("following"))
    parts = sorted(r.part for r in heads.select("part").collect())  # a number for each task
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    last = found.where("kind = 2").select("part", "doc_id", "text").join(after, "part")
    ends = last.join(heads.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "head", "following").mapInArrow(_joined, OUT)
    return found.where("kind = 0").select(*_NAMES).unionByName(ends)
