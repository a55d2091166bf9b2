"""Contigs as training documents, and batches of token rows with labels, loss mask and position ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import bases as B
from strandlake.operators import joins
from strandlake.operators.cohort import Cohort

#: Model ids of A, C, G, T, everything else, and the end of a document.
IDS, EOD = (8, 5, 6, 7, 9), 12


def documents(cohort: Cohort) -> DataFrame:
    """``(doc_ix, asm_id, contig_ix, name, n_tokens)``: one document a contig, its end token counted."""
    by = W.orderBy("asm_id")
    sizes = cohort.contigs.groupBy("asm_id").agg(F.count("*").alias("c"), F.sum(F.col("len") + 1).alias("t"))
    before = sizes.select("asm_id", *(F.coalesce(F.sum(x).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(y) for x, y in (("c", "docs"), ("t", "tokens"))))
    rows = cohort.contigs.join(joins.broadcast_if_small(before), "asm_id")
    return rows.select((F.col("docs") + F.col("contig_ix")).alias("doc_ix"), "asm_id", "contig_ix", "name", (F.col("len") + 1).alias("n_tokens"), (F.col("tokens") + F.col("boff") + F.col("contig_ix")).alias("t0"))


def document_tokens(cohort: Cohort, ids: tuple[int, ...] = IDS, eod: int = EOD) -> DataFrame:
    """``(asm_id, contig_ix, name, tokens)`` with the end token, a document a row: for documents under 2^31 tokens. See ``token_pieces``."""
    rows = cohort.contig_sequences()
    tokens = F.when(F.length("seq") > 0, B.token_ids(F.col("seq"), ids)).otherwise(F.array().cast("array<int>"))
    return rows.select("asm_id", "contig_ix", "name", F.concat(tokens, F.array(F.lit(eod))).alias("tokens"))


def token_pieces(cohort: Cohort, ids: tuple[int, ...] = IDS, eod: int = EOD) -> DataFrame:
    """``(asm_id, contig_ix, at, tokens)``: every document's tokens in pieces of a block at most, from place ``at`` on; the end token is a piece of its own."""
    rows = cohort.contig_parts(case=False)
    rows = rows.select("asm_id", "contig_ix", "at", B.token_ids(F.col("part"), ids).alias("tokens"))
    return rows.union(cohort.contigs.select("asm_id", "contig_ix", F.col("len").alias("at"), F.array(F.lit(eod)).alias("tokens")))


def get(cohort: Cohort, requests: DataFrame, subset: DataFrame | None = None, ids: tuple[int, ...] = IDS, eod: int = EOD) -> DataFrame:
    """``requests(id, doc_ix, offset, length)`` -> ``(id, doc_ix, offset, length, tokens, ends)``: a document's tokens from ``offset`` on.

    ``subset(doc_ix)`` numbers the documents anew, in order, and only those can be asked for. A document's last token is its end token; ``ends``
    tells whether it is among those asked for (if not, a window of the bases alone answers). A request outside its document is an error.
    """
    docs = documents(cohort).select("doc_ix", "asm_id", "contig_ix", "n_tokens")
    if subset is not None:
        docs = docs.join(subset.select("doc_ix").distinct(), "doc_ix", "left_semi")
        by = W.orderBy("doc_ix")  # a row for each document of the subset, no bases
        docs = docs.withColumn("doc_ix", (F.row_number().over(by) - 1).cast("long"))
    r = requests.select("id", "doc_ix", "offset", "length").join(joins.broadcast_if_small(docs), "doc_ix", "left")
    label = F.concat_ws(" ", F.lit("no such tokens:"), *(F.col(c).cast("string") for c in ("id", "doc_ix", "offset", "length")))
    bad = F.col("n_tokens").isNull() | (F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") + F.col("length") > F.col("n_tokens"))
    r = r.withColumn("ends", F.when(bad, F.raise_error(label).cast("boolean")).otherwise((F.col("length") > 0) & (F.col("offset") + F.col("length") == F.col("n_tokens"))))
    c = cohort.contigs.select("asm_id", "contig_ix", "boff")
    # what was asked is one struct, so that a window's key carries it
    asked = F.struct("id", "doc_ix", "offset", "length", "ends").alias("id")
    # a request for a document that isn't there must fail, not drop out of the joins
    r = r.withColumn("asm_id", F.when(F.col("ends").isNotNull(), F.coalesce("asm_id", F.lit(-1)))).join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"], "left")
    r = r.select(asked, "asm_id", (F.col("boff") + F.col("offset")).alias("start"), (F.col("length") - F.col("ends").cast("long")).alias("length"), F.lit(False).alias("rc"))
    rows = cohort.windows(r, case=False)
    bases = F.when(F.length("seq") > 0, B.token_ids(F.col("seq"), ids)).otherwise(F.array().cast("array<int>"))
    tokens = F.when(F.col("id.ends"), F.concat(bases, F.array(F.lit(eod)))).otherwise(bases)
    return rows.select("id.id", "id.doc_ix", "id.offset", F.col("id.length").alias("length"), tokens.alias("tokens"), "id.ends")


def batches(cohort: Cohort, size: int, mask_eod: bool = True, reset: bool = True) -> DataFrame:
    """``(row, tokens, labels, loss_mask, position_ids)``: the documents end to end, cut into rows of ``size`` tokens and the next.

    Labels are the next tokens; with ``mask_eod`` the end tokens' own places have no loss; with ``reset`` positions begin anew
    after each end token. What is left after the last full row is dropped, as it has no full row of labels.
    """
    docs = documents(cohort)
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rows = cohort.spark.range(max(0, (total - 1) // size)).select(F.col("id").alias("row"), (F.col("id") * size).alias("lo"), (F.col("id") * size + size + 1).alias("hi"))
    spans = docs.select("doc_ix", "asm_id", "contig_ix", F.col("t0").alias("rlo"), (F.col("t0") + F.col("n_tokens")).alias("rhi"))
    parts = joins.overlap_join(rows, spans, [], max(size, 1024))
    x0, x1 = F.greatest("lo", "rlo"), F.least("hi", "rhi")
    parts = parts.select("row", "doc_ix", "asm_id", "contig_ix", (x0 - F.col("rlo")).alias("start0"), (x1 - x0).alias("n"), (F.col("hi") >= F.col("rhi")).alias("ends"))
    c = cohort.contigs.select("asm_id", "contig_ix", "boff")
    parts = parts.join(joins.broadcast_if_small(c), ["asm_id", "contig_ix"])
    asked = parts.select(F.struct("row", "doc_ix", "ends").alias("id"), "asm_id", (F.col("boff") + F.col("start0")).alias("start"), (F.col("n") - F.col("ends").cast("int")).alias("length"), F.lit(False).alias("rc"))
    seqs = cohort.windows(asked, tokens=True).select("id.row", "id.doc_ix", F.concat("seq", F.when(F.col("id.ends"), F.lit("5")).otherwise(F.lit(""))).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_ix", "part"))), lambda s: s["part"]), "")
    table = np.array([*IDS, EOD], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                x = table[np.frombuffer(text.encode(), np.uint8) - 48]
                tokens, labels = x[:-1], x[1:]
                mask = np.where(tokens == EOD, 0.0, 1.0) if mask_eod else np.ones(len(tokens))
                place = np.arange(len(tokens))
                if reset:
                    after = np.concatenate(([0], np.where(tokens[:-1] == EOD, place[1:], 0)))
                    place = place - np.maximum.accumulate(after)
                out.append((tokens, labels, mask.astype(np.float32), place.astype(np.int32)))
            kinds = (pa.int32(), pa.int32(), pa.float32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.list_(t)) for k, t in enumerate(kinds))], ["row", "tokens", "labels", "loss_mask", "position_ids"])

    return seqs.groupBy("row").agg(joined.alias("text")).mapInArrow(run, "row long, tokens array<int>, labels array<int>, loss_mask array<float>, position_ids array<int>")
