"""Words, shingles and hashes of texts, for code that runs in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs of other bytes than x20 and x09-x0D, with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ngrams(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; a shorter sequence counts as one run; nothing gives nothing."""
    n = min(width, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * _M1 + h[j : len(h) - n + 1 + j])
    return out


def binaries(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def small_batches(spark, rows: int = 1000) -> None:
    """Rows that one Arrow batch takes to a Python worker: texts may be long, so fewer than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
