"""Fetch requests from a stream, answered in micro-batches from a cohort's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.cohort import Cohort


def serve(requests: DataFrame, cohort: Cohort, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``requests(id, assembly, contig, start0, length, rc)``, a stream -> Parquet with ``seq`` in ``path``.

    Each micro-batch is one ``fetch``: its requests share the scan of the blocks. A batch goes to a folder of its own number
    and replaces what an earlier try of it left, so an answer is written once.
    """

    def answer(batch: DataFrame, n: int) -> None:
        cohort.fetch(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
