"""Language identification by the nearest of several centroids per language.

A text's letters are lower-cased, everything else becomes single spaces; runs of one to three characters are hashed to 2^14
terms and weighed by TF-IDF, scaled to length one. Each language's sample is clustered by spherical k-means, so that a
language that is written in several ways keeps several centroids. A text belongs to the language of the centroid with the
largest cosine; where it is farther from that than nearly all of the cluster's own texts, it is rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm import text as tx

DIM = 2**14
#: Labelled texts of a language that the model is fitted on, at most: those whose ids have the smallest hashes. And languages, the
#: most frequent ones: a label column that is no such thing must not fill the driver.
SAMPLE, LANGUAGES = 300, 400
CLUSTERS, ROUNDS, SHARPNESS = 4, 12, 25.0
NONE = "und"


def letters() -> np.ndarray:
    """Is this code point below 2^16 a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536)


def terms(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of the whole text and their counts; none if it has no letter."""
    codes = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    is_letter = table[np.minimum(codes, 65535)]
    for c in np.unique(codes[codes > 65535]):
        is_letter = is_letter | ((codes == c) & chr(int(c)).isalpha())
    if not is_letter.any():
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first other character after a letter stands for all of its run
    x = np.concatenate(([np.uint32(32)], np.where(is_letter, codes, np.uint32(32))[keep], [np.uint32(32)])).astype(np.uint32)
    mixed = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(18)
    two = x[:-1] * np.uint32(0x01000193) + x[1:]
    three = two[:-1] * np.uint32(0x01000193) + x[2:]
    counts = np.bincount(np.concatenate([mixed(x * np.uint32(0x9E3779B1)), mixed(two * np.uint32(0x9E3779B1)), mixed(three * np.uint32(0x9E3779B1))]), minlength=DIM)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray) -> np.ndarray:
    """Centroids of unit rows: the first nearest to the mean, each next farthest from those before; then k-means."""
    c = x[[int(np.argmax(x @ _unit(x.mean(0))))]]
    while len(c) < min(CLUSTERS, len(x)):
        c = np.concatenate([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[own == k].sum(0)) if (own == k).any() else c[k] for k in range(len(c))])
    return c


class Model:
    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        rows = [r for r in rows if len(r[1])]
        have = np.zeros(DIM)
        for _, at, _ in rows:
            have[at] += 1
        self.idf = (np.log((1 + len(rows)) / (1 + have)) + 1).astype(np.float32)
        by: dict[str, list] = defaultdict(list)
        for lang, at, n in rows:
            v = np.zeros(DIM, np.float32)
            v[at] = self._weigh(at, n)
            by[lang].append(v)
        self.langs = sorted(by)
        owner, found, limits = [], [], []
        for i, lang in enumerate(self.langs):
            x = np.stack(by[lang])
            c = _clusters(x)
            near = x @ c.T
            own = near.argmax(1)
            for k in range(len(c)):
                mine = near[own == k, k]
                limits.append(1.1 * float(np.quantile(1 - mine, 0.995)) if len(mine) else 0.0)
                owner.append(i)
            found.append(c)
        self.owner, self.limits = np.array(owner, int), np.array(limits)
        self.centroids = np.concatenate(found).T.astype(np.float32).copy() if found else np.zeros((DIM, 0), np.float32)

    def _weigh(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _unit((1 + np.log(n)) * self.idf[at])

    def predict(self, data: bytes | None, table: np.ndarray) -> tuple[str, float, float | None, bool]:
        """Language, score, distance to the nearest centroid, and whether that is too far."""
        at, n = terms(data, table) if data else (np.zeros(0), None)
        if not len(at) or not self.langs:
            return NONE, 0.0, None, True
        near = self._weigh(at, n) @ self.centroids[at]
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, near)
        k = int(np.argmax(near))
        e = np.exp(SHARPNESS * (best - best.max()))
        far = float(1 - near[k])
        return self.langs[self.owner[k]], float(e[self.owner[k]] / e.sum()), far, far > self.limits[k]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``docs(doc_id, text, lang)`` whose lang isn't null; at most ``sample`` different ones of each language.

    Rows are ranked in their language, so an id or a row that is repeated however often takes no other's place. The driver holds the
    sample's term counts.
    """
    known = docs.where("lang is not null").select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    rows = known.select("lang", "doc_id", "h").distinct().join(F.broadcast(counts.select("lang")), "lang").withColumn("o", F.xxhash64("doc_id", F.lit(2)))
    # counts of 1024 ranges of the hash tell up to which one a language has enough, so that few more rows than the sample meet in a task
    rows = rows.withColumn("range", F.shiftright("o", 54))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("range"))
    ranges = rows.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("before", upto - F.col("n")).where(F.col("before") < sample)
    rows = rows.join(F.broadcast(ranges.groupBy("lang").agg(F.max("range").alias("last"))), "lang").where("range <= last")
    first = F.row_number().over(W.partitionBy("lang").orderBy("o", "doc_id", "h"))
    some = rows.withColumn("i", first).where(F.col("i") <= sample)
    some = F.broadcast(some.select("lang", F.col("doc_id").alias("id"), "h", "i"))  # sample * LANGUAGES rows at most
    texts = known.join(some, ["lang", "h"]).where(F.col("doc_id").eqNullSafe(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for b in batches:
            rows = [terms(x or b"", table) for x in tx.binaries(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary())], ["lang", "i", "at", "n"])

    rows = texts.select("text", "lang", "i").mapInArrow(run, "lang string, i int, at binary, n binary")
    # repeated rows come back as one: sample * LANGUAGES rows at most
    rows = rows.groupBy("lang", "i").agg(F.min(F.struct("at", "n")).alias("x")).select("lang", "x.at", "x.n").orderBy("lang", "at", "n").collect()
    return Model([(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows])


def identify(docs: DataFrame, training: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, lang_pred, score, distance, rejected)``, a row for each row.

    Learns from ``training(doc_id, text, lang)``. ``lang_pred`` is the nearest centroid's language, ``score`` its share among
    the languages (0 to 1), ``rejected`` whether the text is too far from it. A text that is null or has no letter gets
    ``und``, score 0, a null distance, and is rejected; so does every text if nothing was learned. Rows are judged one by one
    and whole, however long, so ties (the language that sorts first wins), repeated rows and null ids need nothing. An empty table gives an
    empty result. Other columns are not looked at.
    """
    tx.small_batches(docs.sparkSession)
    model = fit(training, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for b in batches:
            rows = [model.predict(x, table) for x in tx.binaries(b.column(1))]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
