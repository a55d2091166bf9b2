"""Quality by nearest-neighbour voting over latent-semantic vectors of labelled documents.

A text's terms are its words and pairs of neighbouring words, and 1- to 5-grams of its shape: its characters with letters, digits and
white space folded into classes and runs of one class shortened; beside them stand the repeats of words and lines. Words and shapes are hashed
to terms of their own, weighed by TF-IDF, each kind scaled to its share of a vector of length one, and
projected together to a few dozen dimensions by a singular value decomposition of the labelled sample. The sample's vectors go to
every task (their number is a parameter, so their size is bounded), and each batch of documents is multiplied with all of
them, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm import text as tx

#: Terms of shapes, and all terms: those of words follow. The share of a text's squared length that its words have.
SHAPES, DIM, WORDS = 4096, 8192, 0.3
#: Labelled documents the model is fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 2500
RANK, NEIGHBOURS, POWER = 48, 25, 8.0
#: Decimals of a cosine that count: products in doubles agree in them whatever the batch, so scores don't depend on it.
DIGITS = 10
_OWN = 16


def _classes() -> np.ndarray:
    """A class for each code point up to 0xFFFF: lower, upper, digit, space and newline fold, other ASCII stays itself."""
    out = np.full(65536, 1, np.uint32)
    for c in range(0x250):
        x = chr(c)
        out[c] = 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdigit() else 5 if x in "\n\r" else 4 if x.isspace() else c + 8
    return out


CLASSES = _classes()


def terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of a text and their counts."""
    codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kinds = CLASSES[np.minimum(codes, 65535)]
    if len(kinds) > 1:
        again = (kinds[1:] == kinds[:-1]) & (kinds[1:] < 6)
        twice = again[1:] & again[:-1]
        kinds = kinds[np.concatenate(([True, True], ~twice))]
    found = []
    h = np.zeros(len(kinds) + 1, np.uint32)
    for n in range(1, 6):
        h = h[:-1] * np.uint32(0x01000193) + kinds[n - 1 :] * np.uint32(0x9E3779B1) if len(h) > 1 else h[:0]
        if not len(h):
            break
        found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20))
    counts = np.bincount(np.concatenate(found), minlength=DIM) if found else np.zeros(DIM, np.int64)  # 12 bits: under SHAPES
    counts[:_OWN] = 0
    words = tx.hashed(tx.ascii_words(data))
    for lag in (1, 2, 3):
        counts[lag] = int((words[lag:] == words[:-lag]).sum()) if len(words) > lag else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts[4] = 4 * (len(lines) - len(set(lines)))
    grams = tx.ngrams(words, 3)
    counts[5] = len(grams) - len(np.unique(grams))
    both = np.concatenate([tx.mix(words), tx.ngrams(words, 2)]) if len(words) > 1 else tx.mix(words)
    counts[SHAPES:] = np.bincount((both >> np.uint64(52)).astype(np.int64), minlength=DIM - SHAPES)  # 12 bits
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def _weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(n.astype(float)) * idf[at]
    shapes = int(np.searchsorted(at, SHAPES))
    for part, share in ((v[:shapes], 1 - WORDS), (v[shapes:], WORDS)):
        part *= math.sqrt(share) / max(float(np.linalg.norm(part)), 1e-9)
    return v / max(float(np.linalg.norm(v)), 1e-9)


class Model:
    """idf, projection (terms x rank), the sample's vectors and their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        keep = [i for i, (at, _) in enumerate(rows) if len(at)]
        rows, self.labels = [rows[i] for i in keep], np.array([labels[i] for i in keep], float)
        have = np.zeros(DIM)
        for at, _ in rows:
            have[at] += 1
        self.idf = (np.log((1 + len(rows)) / (1 + have)) + 0.3).astype(float)
        x = np.zeros((len(rows), DIM), float)
        for i, (at, n) in enumerate(rows):
            x[i, at] = _weigh(at, n, self.idf)
        rank = min(RANK, len(rows))
        if rank:
            rng = np.random.default_rng(8)
            q = np.linalg.qr(x @ (x.T @ (x @ rng.standard_normal((DIM, min(rank + 16, DIM))).astype(float))))[0]
            self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(float).copy()
            self.vectors = self._unit(x @ self.axes)
        else:
            self.axes, self.vectors = np.zeros((DIM, 0), float), np.zeros((0, 0), float)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[bytes | None], block: int = 512) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.vectors):
            return out
        for k in range(0, len(texts), block):
            own = texts[k : k + block]
            v = np.zeros((len(own), self.axes.shape[1]), float)
            some = np.zeros(len(own), bool)
            for i, data in enumerate(own):
                if data and data.strip():
                    at, n = terms(data)
                    if len(at):
                        v[i] = _weigh(at, n, self.idf) @ self.axes[at]
                        some[i] = True
            near = np.round(self._unit(v) @ self.vectors.T, DIGITS)
            m = min(NEIGHBOURS, near.shape[1])
            # equal cosines go to the sample's earlier document; the votes are added nearest first
            order = near - np.arange(near.shape[1]) * (10.0 ** -(DIGITS + 5))
            top = np.argpartition(-order, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(order, top, 1), axis=1), 1)
            w = np.maximum(np.take_along_axis(near, top, 1), 1e-3) ** POWER
            out[k : k + block] = np.where(some, (w * self.labels[top]).sum(1) / w.sum(1), 0)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labels(doc_id, label)`` of ``docs(doc_id, text)``; at most ``sample`` of them, by the hash of the id.

    Of an id's rows the text with the smallest hash counts, so an id that is repeated however often takes no other's place.
    """
    label = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    some = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `sample` ids
    one = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    texts = texts.withColumn("i", one).where("i = 1")  # tasks keep one row of an id before they meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [terms(x or b"") for x in tx.binaries(b.column(1))]
            columns = [b.column(0), b.column(2).cast(pa.int32()), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "at", "n"])

    rows = texts.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(run, "doc_id long, label int, at binary, n binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `sample` rows at most
    return Model([(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32)) for r in rows], [r.label for r in rows])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, score)``: how much of the neighbours' weight has label 1, for each row.

    ``labels(doc_id, label)`` are what it learns from; a doc_id with two labels counts as 1, null ones don't count. A null,
    empty or blank text scores 0, and so does every text if there is no labelled one. Texts are read whole, however long. Rows are scored one by one, so ties,
    repeated rows and null ids need nothing. An empty table gives an empty result. Other columns are not looked at.
    """
    tx.small_batches(docs.sparkSession)
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(tx.binaries(b.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
