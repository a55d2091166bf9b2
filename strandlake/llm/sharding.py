"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row goes to the first virtual node clockwise of its id's hash. A shard takes rows up to its bound, and what is over
goes on clockwise to the next node of a shard with room. With bounds that add up to the rows, the counts of any two shards
differ by one at most.

The ring's arcs number shards times virtual nodes, whatever the input: their counts are all that the driver sees, and it
settles there how many of each arc's rows go on to which shard. Rows are then numbered within their arc, by prefix sums
over 64 parts of it. Rows with the same id, size and text are one entry with a count, so a repeated row can't fill a task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.scratch import Scratch

SPACE, CELL = 2**32, 2**20
PARTS, RUN = 64, 8192


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` in clockwise order. A further shard adds nodes and moves none."""
    return sorted((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(nodes))


def settle(counts: list[int], owners: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Of arcs in clockwise order: segments ``(arc, from, to, shard, slot)`` of each arc's row numbers.

    First every arc fills its owner's shard as far as that has room, in ring order; then what is over goes on clockwise.
    """
    room, filled, out, over = list(bounds), [0] * len(bounds), [], []

    def put(arc: int, since: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((arc, since, since + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return n

    for arc, n in enumerate(counts):
        if n > (took := put(arc, 0, n, owners[arc])):
            over.append((arc, took, n))
    for arc, since, n in over:
        step = arc
        while since < n:
            step = (step + 1) % len(owners)
            since += put(arc, since, n - since, owners[step])
    return out


def shard_rows(docs: DataFrame, shards: int = 16, nodes: int = 64) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, size, text_crc32, shard, slot)``, a row for each row.

    ``size`` is the text's UTF-8 bytes plus 1. Slots of a shard run from 0 without gaps. Shard counts differ by one at most.
    A null text counts as empty (size 1, checksum 0); a null id hashes as an empty one. Repeated rows get slots of their
    own. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = keys.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    point = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    keys = keys.withColumn("point", point).withColumn("cell", F.floor(F.col("point") / CELL))
    keys = keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int"))

    at = ring(shards, nodes)
    arcs = [(i, at[i - 1][0] if i else -1, p) for i, (p, _) in enumerate(at)] + [(0, at[-1][0], SPACE - 1)]
    cells = [(c, arc, lo, hi) for arc, lo, hi in arcs if lo < hi for c in range((lo + 1) // CELL, hi // CELL + 1)]
    # at most shards * nodes + SPACE / CELL rows, whatever the input
    cells = F.broadcast(spark.createDataFrame(cells, "cell long, arc int, lo long, hi long"))
    keys = scratch.save(keys.join(cells, "cell").where("point > lo and point <= hi").drop("cell", "lo", "hi"), "keys")

    parts = keys.groupBy("arc", "part").agg(F.sum("n").alias("c"))
    counts = [0] * len(at)
    for row in parts.groupBy("arc").agg(F.sum("c").alias("c")).collect():  # a row for each arc
        counts[row.arc] = row.c
    rows = sum(counts)
    bounds = [rows // shards + (s < rows % shards) for s in range(shards)]
    segments = settle(counts, [s for _, s in at], bounds)
    # at most two rows for each arc and shard step, whatever the input
    segments = F.broadcast(spark.createDataFrame(segments, "arc int, since long, until long, shard int, slot0 long"))

    upto = F.sum("c").over(W.partitionBy("arc").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("arc", "part", F.coalesce(upto, F.lit(0)).alias("before"))
    run = F.sum("n").over(W.partitionBy("arc", "part").orderBy("point", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0))
    placed = keys.join(parts, ["arc", "part"]).withColumn("end", F.col("before") + run).withColumn("start", F.col("end") - F.col("n"))
    placed = placed.join(segments, "arc").where("start < until and end > since")
    first, last = F.greatest("start", "since"), F.least("end", "until")
    placed = placed.withColumn("slot", F.col("slot0") + first - F.col("since")).withColumn("n", last - first)
    few, many = placed.where(F.col("n") <= RUN), placed.where(F.col("n") > RUN)
    many = many.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    many = many.withColumn("slot", F.col("slot") + F.col("skip")).withColumn("n", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("skip")))
    both = few.unionByName(many.drop("skip").repartition("slot", "shard"))
    each = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1))
    return both.select("doc_id", "size", "text_crc32", "shard", each.alias("slot"))
