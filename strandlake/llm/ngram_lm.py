"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The corpus is cut into batches of documents. Each batch explodes into its n-grams of orders 1 to 3; its distinct ones are sent
to the partition of the count table that their hash belongs to, packed in sorted runs. There the runs of all batches are
added up, and each run gets its counts back. Joined to the batch's n-grams again, they give every word's score, and the
scores are summed per document. A common n-gram is one entry of each batch, so frequent words make no hot partition.

A document is scored by the rest of the corpus: its own counts are taken off. Else every n-gram of it would be known.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text as tx
from strandlake.scratch import Scratch

ORDER, ALPHA = 3, 0.4
#: Words of a batch, and n-grams of a partition of the count table, about.
BATCH_WORDS, PART_KEYS = 700_000, 1_000_000
#: Bits that tell the n-grams of one partition apart: one agrees with another of a million with probability 4e-9.
LOW = 48
#: Bits of a word's hash: of n different words, one agrees with another with probability n / 2^48.
WORD = 48


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, packed: the empty planes take no room, the narrow ones little."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unplanes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def gaps(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def ungaps(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def placed(h: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """Keys that sort by partition of the count table, and the bits under the partition: LOW, or what 64 leave.

    A partition holds about as many n-grams at any size of the corpus, so 48 bits tell all but some 4e-9 of them apart.
    """
    low = min(LOW, 64 - parts.bit_length())
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(low)) | (h & np.uint64(2**low - 1)), low


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, lens, held, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        words = np.concatenate([np.zeros(0, np.uint64), *held])
        codes, vocabulary = pd.factorize(words)  # frequent words come early, so most codes are small
        known = np.array([x is not None for x in ids], bool)
        columns = [
            pa.array([secrets.randbits(63)], pa.int64()), pa.array([len(words)], pa.int64()),
            *(pa.array([x], pa.binary()) for x in (np.array([x or 0 for x in ids], np.int64).tobytes(), known.tobytes(), np.array(lens, np.int64).tobytes(), planes(vocabulary), planes(codes.astype(np.uint32)))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "words", "ids", "known", "lens", "vocabulary", "codes"])

    for b in batches:
        for i, data in zip(b.column(0).to_pylist(), tx.binaries(b.column(1)), strict=True):
            w = tx.hashed(tx.ascii_words(data or b"")) >> np.uint64(64 - WORD)
            ids.append(i)
            lens.append(len(w))
            held.append(w)
            size += len(w)
            if size >= BATCH_WORDS:
                yield flush()
                ids, lens, held, size = [], [], [], 0
    if ids:
        yield flush()


class Grams:
    """A batch's n-grams: for each order, the local number of the one that ends at each word (-1 where none does), and hashes."""

    def __init__(self, vocabulary: bytes, codes: bytes, lens: bytes):
        words, codes = unplanes(vocabulary, np.uint64), unplanes(codes, np.uint32).astype(np.int64)
        self.lens = np.frombuffer(lens, np.int64)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        first = tx.mix(words + np.uint64(1))
        self.ids, self.hashes = [codes], [first]
        for n in range(1, ORDER):
            ok = np.flatnonzero(place >= n)
            own, both = pd.factorize(self.ids[-1][ok - 1] * len(words) + codes[ok])
            ids = np.full(len(codes), -1, np.int64)
            ids[ok] = own
            self.ids.append(ids)
            older, last = (both // max(1, len(words))).astype(np.int64), (both % max(1, len(words))).astype(np.int64)
            self.hashes.append(tx.mix(self.hashes[-1][older] * np.uint64(0x9E3779B97F4A7C15) + first[last] + np.uint64(n)))
        self.counts = [np.bincount(ids[ids >= 0], minlength=len(h)) for ids, h in zip(self.ids, self.hashes, strict=True)]

    def keys(self, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The keys of all n-grams in order, where each stands, and the bits under the partition."""
        keys, low = placed(np.concatenate(self.hashes), parts)
        order = np.argsort(keys, kind="stable")
        return keys[order], order, low

    def own(self, n: int) -> np.ndarray:
        """How often its document holds the n-gram that ends at each word."""
        ids, out = self.ids[n], (self.ids[n] >= 0).astype(np.int64)
        some = np.flatnonzero(ids >= 0)
        some = some[self.counts[n][ids[some]] > 1]  # what the batch has once, its document has once
        doc = np.repeat(np.arange(len(self.lens)), self.lens)[some]
        at, _ = pd.factorize(doc * len(self.hashes[n]) + ids[some])
        out[some] = np.bincount(at)[at] if len(at) else 0
        return out


def _requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, vocabulary, codes, lens in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                grams = Grams(vocabulary, codes, lens)
                keys, order, low = grams.keys(parts)
                counts = np.concatenate(grams.counts)[order]
                cut = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(low)).tolist() if parts > 1 else [0, len(keys)]
                own = [p for p in range(parts) if cut[p] < cut[p + 1]]
                blobs = [gaps(keys[cut[p] : cut[p + 1]]) for p in own]
                sums = [planes(counts[cut[p] : cut[p + 1]].astype(np.uint32)) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(blobs, pa.binary()), pa.array(sums, pa.binary())], ["batch", "part", "keys", "counts"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Of one partition of the count table: what all other batches have of each key asked for, in the order asked."""
    asked = [ungaps(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unplanes(x, np.uint32) for x in table.column("counts").to_pylist()])
    at, keys = pd.factorize(np.concatenate(asked))
    others = np.bincount(at, counts, len(keys)).astype(np.uint64)[at] - counts
    runs = np.split(others, np.cumsum([len(x) for x in asked])[:-1])
    return pa.table([table.column("batch"), table.column("part"), pa.array([planes(x) for x in runs], pa.binary())], ["batch", "part", "others"])


def _scores(corpus: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, known, lens, vocabulary, codes = (left.column(c)[0].as_py() for c in ("ids", "known", "lens", "vocabulary", "codes"))
        grams = Grams(vocabulary, codes, lens)
        lens, words = grams.lens, len(grams.ids[0])
        keys, order, _ = grams.keys(parts)
        runs = sorted(zip(right.column("part").to_pylist(), right.column("others").to_pylist(), strict=True))
        got = np.concatenate([np.zeros(0, np.int64), *(unplanes(x, np.uint64).astype(np.int64) for _, x in runs)])
        if len(got) != len(keys):
            raise ValueError("counts are missing")
        totals = np.concatenate(grams.counts).astype(np.int64)
        totals[order] += got
        totals = np.split(totals, np.cumsum([len(h) for h in grams.hashes])[:-1])
        rest = [np.where(i >= 0, t[i], 0) - grams.own(n) if len(t) else np.zeros(words, np.int64) for n, (i, t) in enumerate(zip(grams.ids, totals, strict=True))]
        doc = np.repeat(np.arange(len(lens)), lens)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(rest[0] > 0, rest[0], ALPHA) / np.maximum(corpus - lens, 1)[doc]
            for n in range(1, ORDER):
                before = np.concatenate((np.zeros(1, np.int64), rest[n - 1]))[:-1]
                score = np.where(grams.ids[n] >= 0, np.where(rest[n] > 0, rest[n] / before, ALPHA * score), score)
        logs = np.bincount(doc, np.log2(score), len(lens)) if words else np.zeros(len(lens))
        mask = ~np.frombuffer(known, bool)
        return pa.table([pa.array(np.frombuffer(ids, np.int64), mask=mask), pa.array(lens), pa.array(logs)], ["doc_id", "n_words", "log2_score"])

    return run


def backoff_scores(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_words, log2_score)``, a row for each row: the sum over the text's words of
    the base-2 logarithm of their stupid-backoff score with n-grams of up to three words.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased. With c the counts in all other rows, a word scores
    c(n-gram) / c(its first n - 1 words) if the n-gram is known, else 0.4 times the next shorter one's score; a single word
    c / N, and 0.4 / N if unknown, N being the other rows' words (1 at least). N-grams don't reach over the text's beginning.

    A null, empty or wordless text has 0 words and score 0. Repeated rows know each other. Null ids are carried along. An
    empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    scratch = Scratch(spark)
    kinds = "batch long, words long, ids binary, known binary, lens binary, vocabulary binary, codes binary"
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packed, kinds)
    corpus = scratch.save_by(packed, "batches", "batch", int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = corpus.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    parts = max(1, -(-words * ORDER // PART_KEYS))
    asked = corpus.select("batch", "vocabulary", "codes", "lens").mapInArrow(_requests(parts), "batch long, part int, keys binary, counts binary")
    totals = asked.groupBy("part").applyInArrow(_added, "batch long, part int, others binary")
    return corpus.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(_scores(words, parts), "doc_id long, n_words long, log2_score double")
