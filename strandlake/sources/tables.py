"""Tab-separated tables with fixed schemas. ``#`` is an ordinary character: it occurs in contig names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "requests": "id string, assembly string, contig string, start0 long, length long",
    "law_requests": "w int, id string, assembly string, contig string, start0 long, end0 long",
    "region_requests": "id string, assembly string, contig string, start0 long, end0 long",
    "truth": "kind string, id string, value string",
    "patterns": "pid long, class string, seq string, origin string",
    "guides": "gid long, source string, spacer string, origin string",
    "manifest": "name string, url string, hash_type string, source_hash string, fasta_bytes long, fasta_xxh3 string, "
    "q4k_bytes long, q4k_sha256 string, q16k_bytes long, q16k_sha256 string, status string, seconds double",
    "names": "name string",
}


def read_tsv(spark: SparkSession, path: str, kind: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SCHEMAS[kind], header=header, quote="", comment=None, mode="FAILFAST")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)


def against_manifest(found: DataFrame, manifest: DataFrame, key: str, value: str) -> DataFrame:
    """``(name, status)``: ``ok``, ``differs``, ``missing`` (only in the manifest) or ``unknown`` (only found)."""
    from pyspark.sql import functions as F

    a, b = found.select(F.col(key).alias("name"), F.col(value).alias("a")), manifest.select(F.col(key).alias("name"), F.col(value).alias("b"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unknown").when(F.col("a") == F.col("b"), "ok").otherwise("differs")
    return a.join(b, "name", "full_outer").select("name", status.alias("status"))
