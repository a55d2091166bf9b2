"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

For every item of L words, every window of L words of a document is a candidate. Windows get a 192-bit SimHash over their
5-word shingles, each weighing as often as it occurs. The index cuts fingerprints into twelve blocks of sixteen bits: two that
differ in at most 47 bits differ in at most 3 within some block (the pigeonhole principle), so looking up all values within
3 bits of each block finds every item within the radius. An unrelated item is met with a probability of 12 % (697 of 65,536
values in each of twelve blocks), then its whole fingerprint is compared. What is left is compared exactly, by the weighted Jaccard
similarity of the shingles; at 0.8 or more the document holds the item. At just 0.8, fingerprints lie 29 bits apart on
average, and farther apart than 47 with a probability of 1e-4.

A window that shares less than 0.8 of its shingles with the items of its size can't reach 0.8 with any; it needs no fingerprint.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import text as tx

SHINGLE, THRESHOLD = 5, 0.8
LONGS, BLOCK_BITS, BLOCKS, RADIUS = 3, 16, 12, 47
#: Items, and words in them, that one pass over the documents takes: some 110 MB of a Python worker. More are taken in more passes.
ITEMS, ITEM_WORDS = 100_000, 4_000_000
#: Fingerprints that are looked up together.
TOGETHER = 128
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: What changes at most a block's share of the radius: a value's neighbours in the index.
_NEAR = np.array([sum(1 << b for b in some) for n in range(RADIUS // BLOCKS + 1) for some in combinations(range(BLOCK_BITS), n)], np.int64)


def words(data: bytes) -> np.ndarray:
    """Hashes of the words: runs of letters, digits, underscores and other than ASCII characters, in lower case."""
    return tx.hashed(data.decode("utf-8", "replace").lower().encode().translate(_TABLE).split())


def simhash(grams: np.ndarray) -> np.ndarray:
    """The fingerprint: of each bit, whether most of the grams' hashes have it; where half of them do, the smallest gram's."""
    hashes = np.stack([grams, *(tx.mix(grams + np.uint64(k)) for k in range(1, LONGS))], axis=1)
    bits = np.unpackbits(hashes.view(np.uint8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64)
    return np.packbits(np.where(ones == len(grams), bits[grams.argmin()] == 1, ones > len(grams))).view(np.uint64)


def blocks(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.uint16).astype(np.int64)


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int, bytes]]):
        ids, lengths, bags, codes = [], [], [], []
        known: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for item, data in items:
            w = words(data)
            if len(w):
                g = tx.ngrams(w, SHINGLE)
                ids.append(item)
                lengths.append(len(w))
                bags.append(np.unique(g, return_counts=True))
                codes.append(simhash(g))
                known[min(SHINGLE, len(w))].append((bags[-1][0], len(w)))
        self.ids, self.lengths = ids, np.array(lengths, np.int64)
        self.codes = np.stack(codes) if codes else np.zeros((0, LONGS), np.uint64)
        # for each shingle width: the items' shingles, and the sizes of the items that have each
        self.known = {}
        for width, own in known.items():
            grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
            sizes = np.repeat([n for _, n in own], [len(g) for g, _ in own])
            pairs = np.unique(np.stack([at, sizes], axis=1), axis=0).astype(np.int32)
            self.known[width] = grams, np.searchsorted(pairs[:, 0], np.arange(len(grams) + 1)), pairs[:, 1]
        self.cuts = np.cumsum([0, *(len(g) for g, _ in bags)])
        self.bags = np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in bags)])
        self.counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in bags)]).astype(np.int32)
        own = blocks(self.codes)
        self.posted = [np.argsort(own[:, k], kind="stable").astype(np.int32) for k in range(BLOCKS)]
        self.starts = [np.searchsorted(own[self.posted[k], k], np.arange(2**BLOCK_BITS + 1)).astype(np.int32) for k in range(BLOCKS)]

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(code, item)``: the items that agree with a code within 3 bits in a block at least, each once."""
        found = [np.zeros(0, np.int64)]
        for k in range(BLOCKS):
            near = blocks(codes)[:, k, None] ^ _NEAR
            since, until = self.starts[k][near], self.starts[k][near + 1]
            at = np.nonzero(until > since)
            n = (until[at] - since[at]).astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(at[0], n) * len(self.ids) + self.posted[k][np.repeat(since[at], n) + within])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.ids)), both % max(1, len(self.ids))

    def within(self, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(code, item)``: every item of this size whose fingerprint is within the radius."""
        code, item = self.met(codes)
        same = self.lengths[item] == size
        code, item = code[same], item[same]
        near = np.bitwise_count(self.codes[item] ^ codes[code]).sum(axis=1) <= RADIUS
        return code[near], item[near]

    def similarity(self, grams: np.ndarray, counts: np.ndarray, item: int) -> float:
        """The weighted Jaccard similarity of a window's distinct grams and an item's."""
        cut = slice(self.cuts[item], self.cuts[item + 1])
        own, n = self.bags[cut], self.counts[cut]
        at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
        both = int(np.minimum(counts, n[at])[own[at] == grams].sum())
        return both / max(1, int(counts.sum()) + int(n.sum()) - both)

    def matches(self, data: bytes | None) -> dict[int, tuple[float, int]]:
        """Items that the text holds: the best similarity and the first word of the window that has it."""
        w = words(data) if data else np.zeros(0, np.uint64)
        best: dict[int, tuple[float, int]] = {}
        for width, (known, since, sizes) in self.known.items():
            if len(w) < 1:
                break
            g = tx.ngrams(w, width)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            places = np.flatnonzero(known[at] == g)
            if not len(places):
                continue
            n = since[at[places] + 1] - since[at[places]]
            of = sizes[np.repeat(since[at[places]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            places = np.repeat(places, n)
            for size in np.unique(of).tolist():
                # windows of an item's size that share enough with the items of that size together
                upto = np.concatenate(([0], np.cumsum(np.bincount(places[of == size], minlength=len(g)))))
                n = min(max(size - width + 1, 1), len(g))
                starts = np.flatnonzero(upto[n:] - upto[:-n] >= THRESHOLD * n - 1e-9)
                for k in range(0, len(starts), TOGETHER):
                    some = starts[k : k + TOGETHER]
                    codes = np.stack([simhash(g[s : s + n]) for s in some])
                    last, bag = -1, None
                    for c, i in zip(*(x.tolist() for x in self.within(codes, size)), strict=True):
                        if c != last:
                            last, bag = c, np.unique(g[some[c] : some[c] + n], return_counts=True)
                        if (x := self.similarity(*bag, i)) >= THRESHOLD and x > best.get(i, (0, 0))[0]:
                            best[i] = (x, int(some[c]))
        return {self.ids[i]: x for i, x in best.items()}


def passes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """An index for each part of the items that is small enough, sent to each executor; one in the usual case."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-rows // ITEMS), -(-size // (4 * ITEM_WORDS)))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text.encode()) for r in part.collect()]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text)`` -> ``(doc_id, item_id, similarity, start_word)``: a row for
    each document row and item that has a window in it with a similarity of 0.8 or more, the best one, the first of equals.

    A document shorter than an item is one window. Null, empty or wordless texts and items match nothing. Items with the same
    text are all reported; repeated document rows are reported each. A null id is carried along. Empty tables give an empty
    result. Other columns are not looked at. Long texts are looked at whole.
    """
    spark = docs.sparkSession
    tx.small_batches(spark)
    schema = "doc_id long, item_id long, similarity double, start_word long"
    out = None
    for index in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, i, x, s) for d, t in zip(b.column(0).to_pylist(), tx.binaries(b.column(1)), strict=True) for i, (x, s) in index.value.matches(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "start_word"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    tx.small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not index.value.matches(t) for t in tx.binaries(b.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
