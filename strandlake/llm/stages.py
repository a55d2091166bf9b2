"""The corpus pipeline's stages. Each takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import knn, minhash, mixing, sharding, simhash
from strandlake.llm import text as tx

#: Scores under this are rejected.
QUALITY = 0.3


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that are not held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels and the texts in ``sf_dir``.

    Null, empty and blank texts hold nothing to train on and are rejected like any text that scores under ``QUALITY``; without a
    labelled text nothing could be kept, so that is an error, unless ``docs`` is empty too. Long texts are scored whole. Rows are
    judged one by one: repeated ones share their fate, null ids and other columns are carried along.
    """
    tx.small_batches(spark)
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = knn.fit(known, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    if not len(model.vectors) and not docs.isEmpty():
        raise ValueError(f"no labelled text in {sf_dir} to learn quality from")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(tx.binaries(b.column(at))) >= QUALITY, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id of a group stays; null ids give way to others. Null, empty and blank texts all stay, as do all groups however
    large their texts. Of rows that repeat an id one stays for each different text. An empty table gives an empty result; other
    columns are carried along.
    """
    return minhash.one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null, empty and blank texts hold none and stay. Long texts are looked at whole. Rows are judged one by one: repeated ones share
    their fate, null ids and other columns are carried along. Empty tables of documents or items change nothing.
    """
    return simhash.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix begins it, twice, once or not at all, in the order of the schedule. Texts stay whole.

    Null, empty and blank texts have no words to take and aren't in the mix. Rows that agree in all columns are taken like different
    ones. An empty table gives an empty result; other columns are carried along.
    """
    return mixing.rows_in_order(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document: ``(doc_id, size, text_crc32, shard, slot)``.

    Every row gets a slot of its own, repeated ones too; a null text has size 1, a null id hashes as an empty one. Long texts count by
    their bytes but shards are equal in rows. An empty table gives an empty result. Other columns are left out.
    """
    return sharding.shard_rows(docs)
