"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slot n of the schedule is the golden-ratio point frac(n * phi); the source whose stretch of the cumulative targets holds
it gives the slot's block. Slots are ranked per source, and slot r of a source is block r of its documents' words, laid
end to end in hash order, twice over if need be. Every stretch of the schedule so holds each source in nearly its share.

A source may hold any part of the rows: documents are placed by prefix sums over (source, 16 bits of the hash), slots are
ranked by prefix sums over (source, chunk of the schedule), and blocks are joined by (source, block). Rows that agree in all that
counts are one entry until they have their places. Only tables with a row for each source, or for each slot that the schedule's
discrepancy leaves open (some for each source), are sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.joins import broadcast_if_small
from strandlake.scratch import Scratch

GOLDEN = 0.6180339887498949
#: Words of a block; cells that the cumulative targets are looked up by; slots that are ranked together.
BLOCK, CELLS, CHUNK = 2048, 4096, 65536
#: Digits of the hash that prefix sums and ranges are cut by; rows that agree and are dealt together.
COARSE, FINE, CUT, RUN = 2, 4, 3, 8192
#: Parts of the schedule that rows are put in order by, for each shuffle partition; bounds of them, at 16 bytes, that go to every task.
STRETCHES, BOUNDS = 16, 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column) -> Column:
    """The shuffle: a hash of the id and the text. Rows that agree in both can stand for one another."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(k, source_size, target, quota, lo, hi, slots)`` for each source; sorts the sources, of which there are few, in one task."""
    by_rank = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source", "k").agg(F.sum("words").alias("source_size"))
    s = s.withColumn("i", F.row_number().over(by_rank) - 1)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "i")
    before, rest = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(rest)).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level))
    s = s.withColumn("quota", F.round("target").cast("long"))
    upto = F.sum("quota").over(by_rank.rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("lo", F.coalesce(upto / F.nullif(F.sum("quota").over(whole), F.lit(0)), F.lit(0.0)))
    s = s.withColumn("hi", F.lead("lo", 1, 1.0).over(by_rank)).withColumn("slots", F.ceil(F.col("quota") / F.lit(float(BLOCK))))
    return s.select("k", "source_size", "target", "quota", "lo", "hi", "slots")


def _schedule(sources: DataFrame, total: int) -> DataFrame:
    """``(k, r, position)``: slot r of source k comes at this position of the mix. As many slots as each quota needs."""
    spark = sources.sparkSession
    at = F.col("id") * F.lit(GOLDEN)
    points = spark.range(total).select(F.col("id").alias("n"), (at - F.floor(at)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS).cast("int")).withColumn("chunk", F.floor(F.col("n") / CHUNK))
    cells = F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))
    cuts = sources.where("lo < hi").select("k", "lo", "hi", "slots", F.explode(cells).alias("cell"))
    mapped = points.join(cuts, "cell").where("x >= lo and x < hi").select("k", "n", "chunk", "slots")
    counts = mapped.groupBy("k", "chunk").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy("k").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(upto, F.lit(0)))
    rank = F.row_number().over(W.partitionBy("k", "chunk").orderBy("n")) - 1
    ranked = mapped.join(counts.drop("c"), ["k", "chunk"]).withColumn("r", F.col("before") + rank)
    ranked = ranked.where("r < slots").select("k", "r", F.col("n").alias("position"))
    # the schedule's discrepancy leaves a few slots of some sources open; they come last
    had = counts.groupBy("k").agg(F.sum("c").alias("had"))
    short = sources.join(had, "k", "left").select("k", "slots", F.coalesce("had", F.lit(0)).alias("had")).where("had < slots")
    short = short.select("k", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("r"))
    short = short.withColumn("position", F.lit(total) + F.row_number().over(W.orderBy("r", "k")) - 1)
    return ranked.union(short.select("k", "r", F.col("position").cast("long")))


@dataclass
class Mix:
    """documents: ``(doc_id, source, size, h, k, o, source_size, target, quota, copies)``; pieces: which words stand at which
    position; slots: the schedule's length."""

    documents: DataFrame
    pieces: DataFrame
    slots: int

    def taken(self) -> DataFrame:
        """``documents`` with ``taken``, the words that the mix takes of each, repeats counted, and ``position``, the first slot
        of the schedule that has words of it (null if none)."""
        keys = [c for c in self.documents.columns if c != "size"]
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("position", F.lit(None).cast("long"))
        words = F.coalesce(F.sum(F.col("until") - F.col("since")), F.lit(0)).alias("taken")
        some = self.pieces.groupBy(*keys, "size").agg(words, F.min("position").alias("position"))
        return some.unionByName(none)

    def begun(self) -> DataFrame:
        """``(h, k, size, copies, epoch, position)``: where a document begins in the mix, a row for each time that it does."""
        first = (F.col("since") == F.col("o") + F.col("epoch") * F.col("source_size")) & (F.col("since") < F.col("quota"))
        return self.pieces.where(first).select("h", "k", "size", "copies", "epoch", "position")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> Mix:
    """Mix ``docs(doc_id, text, source, ...)``: sources by code point, null last, weigh ``weights`` in turn and share ``share``
    of all words; no target passes ``most`` (2 at most) times its source's words, and what is over goes to the others by weight.

    ``pieces`` has a row for each part of a document in a block: ``position`` of the block's slot and the words ``since`` to
    ``until`` of the source's stream, null where no slot takes the document. A source takes its rounded target to the word.

    A null or empty text has no words and is never taken. Null sources are one source. Repeated rows are laid one after the
    other, so each is taken like a different one; they are one entry with a count until their places are known. Equal hashes
    of different rows, and rows that agree in id and text, follow by size and id. A very long text fills as many blocks as it
    needs. An empty table, or one without words, gives no piece. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    k = source_key(F.col("source")).alias("k")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("h"), k)
    sizes = sizes.groupBy("doc_id", "source", "size", "h", "k").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    sizes = scratch.save(sizes.withColumn("fine", F.substring("h", 1, FINE)), "sizes")
    sources = scratch.save(_targets(sizes, weights, share, most), "sources")
    # prefix sums in three steps, over 256 parts of a source, 256 of a part, and the rows of one
    fine = sizes.groupBy("k", "fine").agg(F.sum("words").alias("c")).withColumn("coarse", F.substring("fine", 1, COARSE))
    coarse = fine.groupBy("k", "coarse").agg(F.sum("c").alias("c"))
    upto = lambda key, by: F.coalesce(F.sum("c").over(W.partitionBy(*key).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("k", "coarse", upto(["k"], "coarse").alias("parts")).join(sources.drop("lo", "hi", "slots"), "k")
    fine = fine.withColumn("part", upto(["k", "coarse"], "fine")).join(coarse, ["k", "coarse"])
    fine = fine.withColumn("before", F.col("parts") + F.col("part")).drop("c", "coarse", "parts", "part")
    within = W.partitionBy("k", "fine").orderBy("h", "size", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = sizes.join(fine, ["k", "fine"]).withColumn("o", F.col("before") + F.sum("words").over(within) - F.col("words"))
    placed = placed.drop("before", "fine", "words")
    # repeated rows: runs of them first, dealt anew, then each by itself
    once, many = placed.where("copies = 1"), placed.where("copies > 1")
    runs = many.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))).repartition("h", "j")
    each = runs.withColumn("j", F.explode(F.sequence(F.col("j"), F.least(F.col("j") + RUN, F.col("copies")) - 1)))
    placed = once.unionByName(each.withColumn("o", F.col("o") + F.col("j") * F.col("size")).drop("j"))
    placed = scratch.save(placed, "placed")

    start = F.col("o") + F.col("epoch") * F.col("source_size")
    parts = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))))
    parts = parts.withColumn("start", start).withColumn("end", F.least(F.col("start") + F.col("size"), F.col("quota")))
    blocks = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    takes = F.col("start") < F.col("quota")
    none = parts.where(~takes).withColumn("r", F.lit(None).cast("long")).withColumn("position", F.lit(None).cast("long"))
    parts = parts.where(takes).withColumn("r", F.explode(blocks))
    slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    pieces = parts.join(_schedule(sources, slots), ["k", "r"]).unionByName(none)
    there = F.col("position").isNotNull()
    pieces = pieces.withColumn("since", F.when(there, F.greatest("start", F.col("r") * BLOCK)))
    pieces = pieces.withColumn("until", F.when(there, F.least("end", (F.col("r") + 1) * BLOCK)))
    return Mix(placed, scratch.save(pieces.drop("start", "end"), "pieces"), slots)


def _number(h: Column) -> Column:
    """The first 15 hexadecimal digits."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _last_not_above(bounds: Column, x: Column) -> Column:
    """Which of the sorted ``bounds``, counted from 1, is the last that isn't above ``x`` (the first, if all are), by bisection."""
    mid = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.element_at(bounds, mid(s)) <= x, pair(mid(s), s["hi"])).otherwise(pair(s["lo"], mid(s) - 1))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds))).cast("int"))
    return F.aggregate(steps, pair(F.lit(1), F.size(bounds)), step, lambda s: s["lo"])


def _in_stretches(rows: DataFrame, begun: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(__h, __k, ..)`` with ``__stretch``, once for each time that the mix begins the row.

    A source's documents follow in the order of their hashes, and each epoch begins those up to some hash. So for each source and epoch
    that hash and the sorted hashes at which stretches begin tell where a row goes, by bisection. With more than ``BOUNDS`` of them
    (sources times stretches), rows are joined to ranges of hashes by source and first digits instead.
    """
    ranges = scratch.save(begun.groupBy("k", "epoch", "stretch").agg(F.min("h").alias("since"), F.max("h").alias("last")), "ranges")
    if ranges.limit(BOUNDS + 1).count() <= BOUNDS:
        each = F.array_sort(F.collect_list(F.struct(_number(F.col("since")).alias("since"), "stretch")))
        bounds = ranges.groupBy("k", "epoch").agg(each.alias("x"), F.max("last").alias("__last"))
        bounds = bounds.select(F.col("k").alias("__k"), "__last", F.col("x.since").alias("__bounds"), F.col("x.stretch").alias("__stretches"))
        placed = rows.join(F.broadcast(bounds), "__k").where("__h <= __last")
        return placed.withColumn("__stretch", F.element_at("__stretches", _last_not_above(F.col("__bounds"), _number(F.col("__h")))))
    cell = lambda c: F.conv(F.substring(c, 1, CUT), 16, 10).cast("int")
    ranges = ranges.select(F.col("k").alias("__k"), F.col("stretch").alias("__stretch"), F.col("since").alias("__since"), F.col("last").alias("__last"), F.explode(F.sequence(cell("since"), cell("last"))).alias("__cell"))
    return rows.withColumn("__cell", cell("__h")).join(ranges, ["__k", "__cell"]).where("__h >= __since and __h <= __last")


def rows_in_order(docs: DataFrame, mixed: Mix) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)``, whole and with all their columns, in the order of the mix: a row comes as
    often as the mix begins it, twice, once or not at all.

    The schedule is cut into stretches, ``STRETCHES`` for each shuffle partition, so work is dealt as finely as the shuffle is. Where a row goes is
    told on the map side (``_in_stretches``), and texts are shuffled once, to their stretch; within one they come by their hashes.
    Rows that agree in id and text are counted first and come as often as all of them do.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = max(1, -(-mixed.slots // (STRETCHES * parts)))
    begun = scratch.save(mixed.begun().withColumn("stretch", F.floor(F.col("position") / length)), "begun")
    repeats = begun.where("copies > 1").groupBy("h", "k", "stretch").agg(F.count("*").alias("times"))
    repeats = scratch.save(repeats.select(*(F.col(c).alias(f"__{c}") for c in repeats.columns)), "repeats")
    again = scratch.save(mixed.documents.where("copies > 1 and size > 0").select(F.col("h").alias("__h"), F.col("k").alias("__k")).distinct(), "again")

    keyed = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    keyed = keyed.withColumn("__h", order_key(F.col("doc_id"), F.col("text"))).withColumn("__k", source_key(F.col("source")))
    entry = ["__h", "__k"]
    repeated = not again.isEmpty()
    single = keyed.join(broadcast_if_small(again), entry, "left_anti") if repeated else keyed
    placed = _in_stretches(single, begun, scratch).select(*names, "__h", "__stretch", F.lit(1).cast("long").alias("__times"))
    if repeated:
        # counted where they are read; kinds of them that differ in other columns take their entry's places in proportion
        alike = keyed.join(broadcast_if_small(again), entry, "left_semi").groupBy(*entry, *names).agg(F.count("*").alias("__rows"))
        kinds = W.partitionBy(*entry).orderBy(F.desc("__rows"), *(c for c in names if not isinstance(docs.schema[c].dataType, T.MapType)))
        alike = alike.withColumn("__upto", F.sum("__rows").over(kinds.rowsBetween(W.unboundedPreceding, 0)))
        alike = alike.withColumn("__all", F.sum("__rows").over(W.partitionBy(*entry))).join(repeats, entry)
        share = lambda upto: F.floor(F.col("__times") * upto / F.col("__all"))
        alike = alike.withColumn("__times", share(F.col("__upto")) - share(F.col("__upto") - F.col("__rows"))).where("__times > 0")
        placed = placed.unionByName(alike.select(*names, "__h", "__stretch", "__times"))
    # slots that the schedule's discrepancy left open come after the last stretch
    own = F.least(F.floor(F.col("__stretch") / STRETCHES), F.lit(parts - 1)).cast("int")
    placed = placed.repartitionById(parts, own)
    out = placed.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.sortWithinPartitions("__stretch", "__h").select(*names)
