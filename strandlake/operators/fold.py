"""Hashes over long sequences that come in parts: the parts pass through a task in order, and only the hash's state is held."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that come to a Python worker together are at most a batch, whatever the sequence's length.
_OUT = "n long, sha256 string"


def sha256_in_order(parts: DataFrame, keys: list[str], at: str, value: str, between: bytes = b"") -> DataFrame:
    """``(*keys, n, sha256)``: for each key the hash of its ``value`` parts in order of ``at``, with ``between`` between them, and the parts' bytes.

    Parts are shuffled by key and sorted, which spills as it must; a task holds a batch of parts and one state. SHA-256 goes
    through a sequence from its start to its end, so one sequence is one task's work, but no row and no value is as long as it. Null parts count as
    empty; keys may be null.
    """
    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "n", "sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, state = None, 0, None
        schema = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, schema, strict=True)), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names)

        for b in batches:
            schema = [b.column(i).type for i in range(len(keys))]
            own = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)
            for k, part in zip(own, b.column(len(keys)), strict=True):
                if k != key or state is None:
                    if state is not None:
                        yield row()
                    key, n, state = k, 0, hashlib.sha256()
                elif between:
                    state.update(between)
                if part.is_valid:
                    data = part.as_buffer()
                    state.update(data)
                    n += data.size
        if state is not None:
            yield row()

    rows = parts.select(*keys, at, F.col(value).cast("binary").alias("__part")).repartition(*keys).sortWithinPartitions(*keys, at)
    return rows.select(*keys, "__part").mapInArrow(run, f"{kinds}, {_OUT}")
