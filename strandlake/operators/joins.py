"""Joins that Spark has no operator for: by position, with bins, and broadcasts of a checked size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.scratch import Scratch

#: Rows that a broadcast may have; more are joined by a shuffle.
SMALL = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which it counts; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bins(lo: Column, hi: Column, size: int) -> Column:
    """One row for each bin of ``size`` positions that [lo, hi) touches; none if it is empty."""
    return F.explode(F.when(hi > lo, F.sequence(F.floor(lo / size), F.floor((hi - 1) / size))).otherwise(F.array().cast("array<bigint>")))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], size: int) -> DataFrame:
    """Pairs of ``left(.., lo, hi)`` and ``right(.., rlo, rhi)`` that agree in ``on`` and overlap, each once.

    An equi-join on the bin of the overlap's first position. ``size`` should be about an interval's length; keys with many
    intervals are spread over their bins.
    """
    a = left.withColumn("__bin", bins(F.col("lo"), F.col("hi"), size))
    b = right.withColumn("__bin", bins(F.col("rlo"), F.col("rhi"), size))
    both = a.join(b, [*on, "__bin"]).where("lo < rhi and rlo < hi")
    return both.where(F.floor(F.greatest("lo", "rlo") / size) == F.col("__bin")).drop("__bin")


def point_join(points: DataFrame, spans: DataFrame, on: list[str], size: int) -> DataFrame:
    """``points(.., pos)`` with the ``spans(.., lo, hi)`` that hold them."""
    a = points.withColumn("__bin", F.floor(F.col("pos") / size))
    b = spans.withColumn("__bin", bins(F.col("lo"), F.col("hi"), size))
    return a.join(b, [*on, "__bin"]).where("pos >= lo and pos < hi").drop("__bin")


#: Distinct starts of a key that one task merges; a key with more is cut into ranges of its starts.
MERGE = 200_000


def merged(spans: DataFrame, on: list[str], most: int = MERGE) -> DataFrame:
    """The union of ``spans(.., lo, hi)`` for each key; touching ones coalesce, empty ones go. Keys may be null.

    Of the spans that begin at one place the longest stays, before anything is shuffled by key. A key of more than ``most`` places is
    cut into ranges by quantiles of them; each range is merged by a task of its own. What earlier ranges reach is a
    prefix maximum over the ranges, a row each: spans within that reach belong to the last run that an earlier range began.
    """
    rows = spans.where("hi > lo").groupBy(*on, "lo").agg(F.max("hi").alias("hi"))
    sizes = rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    scratch = Scratch(spans.sparkSession)
    large = scratch.save(sizes.select(*(F.col(k).alias(f"__{k}") for k in on), "__n"), "large")
    if large.isEmpty():
        return _merged_in(rows, on).select(*on, "lo", "hi")
    same = lambda left, right: reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[f"__{k}"]) for k in on), F.lit(True))
    rows = scratch.save(rows, "starts")
    parts = F.least(F.ceil(F.col("__n") / most), F.lit(4096)).cast("int")
    # as many quantiles as the largest key has ranges, and no more: they stand in every plan that reads them
    p = large.agg(F.max(parts)).first()[0]
    large = broadcast_if_small(large)
    own = rows.join(large, same(rows, large))
    cuts = own.groupBy(*(F.col(f"__{k}") for k in on)).agg(F.percentile_approx("lo", [i / p for i in range(1, p)], 20_000).alias("q"), F.first(parts).alias("p"))
    some = F.transform(F.sequence(F.lit(1), F.col("p") - 1), lambda i: F.element_at("q", F.greatest(F.floor(i * p / F.col("p")), F.lit(1)).cast("int")))
    cuts = scratch.save(cuts.withColumn("__cuts", F.array_distinct(some)).drop("q", "p"), "cuts")
    cuts = broadcast_if_small(cuts)
    ranged = rows.join(cuts, same(rows, cuts), "left").withColumn("__bin", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col("lo"))), F.lit(0)))
    local = scratch.save(_merged_in(ranged.select(*on, "__bin", "lo", "hi"), [*on, "__bin"]), "merged")

    # narrow from here: a row a range, then the merged spans
    before = W.partitionBy(*on).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    tops = local.groupBy(*on, "__bin").agg(F.max("hi").alias("__top")).withColumn("__reach", F.max("__top").over(before)).drop("__top")
    flat = lambda df: df.select(*(F.col(k).alias(f"__{k}") for k in on), F.col("__bin").alias("__b"), *(c for c in df.columns if c not in (*on, "__bin")))
    tops = broadcast_if_small(flat(tops))
    new = local.join(tops, same(local, tops) & (local["__bin"] == tops["__b"])).select(*on, "__bin", "lo", "hi", (F.col("__reach").isNull() | (F.col("lo") > F.col("__reach"))).alias("__new"))
    new = scratch.save(new, "new")
    last = new.groupBy(*on, "__bin").agg(F.max(F.when(F.col("__new"), F.col("lo"))).alias("__last")).withColumn("__run", F.max("__last").over(before)).drop("__last")
    last = broadcast_if_small(flat(last))
    runs = new.join(last, same(new, last) & (new["__bin"] == last["__b"])).select(*on, "lo", "hi", F.when(F.col("__new"), F.col("lo")).otherwise(F.col("__run")).alias("__run"))
    return runs.groupBy(*on, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*on, "lo", "hi")


def _merged_in(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each key's spans, one key a task."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    df = df.withColumn("__top", F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)))
    df = df.withColumn("__run", F.sum((F.col("__top").isNull() | (F.col("lo") > F.col("__top"))).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def covered(spans: DataFrame, on: list[str], lengths: DataFrame) -> DataFrame:
    """``(*on, length, covered, uncovered_share)``: how much of ``lengths(*on, length)`` the spans' union covers; without spans nothing is."""
    union = merged(spans, on).groupBy(*on).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    rows = lengths.join(union, on, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.select(*on, "length", "covered", (1 - F.col("covered") / F.col("length")).alias("uncovered_share"))


def _first_of_key(order) -> Column:
    """The first entry of a key: what a row without one before it takes. Found once a key, as a frame from each row to the key's end would be read anew
    for each row."""
    return F.first("__hit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def as_of(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Each row of ``left(.., pos)`` with ``value`` and ``at`` of the last row of ``right(.., at, value)`` with at <= pos, or the
    first one if there is none before. One sort of both sides by (key, position), no pairs."""
    a = left.select(*left.columns, F.col("pos").alias("__p"), F.lit(1).alias("__side"), F.lit(None).cast("struct<at:bigint,value:bigint>").alias("__hit"))
    b = right.select(*on, F.col("at").alias("__p"), F.lit(0).alias("__side"), F.struct(F.col("at").cast("long").alias("at"), F.col(value).cast("long").alias("value")).alias("__hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*on).orderBy("__p", "__side")
    last = F.last("__hit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("__hit", F.coalesce(last, _first_of_key(order))).where("__side = 1")
    return both.select(*left.columns, F.col("__hit.at").alias("at"), F.col("__hit.value").alias(value))


def as_of_longest(left: DataFrame, right: DataFrame, on: list[str], back: int = 16) -> DataFrame:
    """Each row of ``left(.., pos)`` with one of ``right(.., at, len, value)``: of the last ``back`` entries in order of (at, value) with at <= pos the
    longest that holds pos (of equally long ones the last); if none does, the last one with at <= pos; if there is none, the first of its key.

    Every entry carries those before it, ``back`` in all, so that one sort of both sides by (key, position) finds them; a key without
    entries gives nulls. Adds ``at``, ``len`` and ``value``.
    """
    one = F.struct(F.col("at").cast("long").alias("at"), F.col("value").cast("long").alias("value"), F.col("len").cast("long").alias("len"))
    order = W.partitionBy(*on).orderBy("at", "value", "len")
    held = right.select(*on, "at", "value", "len", one.alias("__one"))
    held = held.withColumn("__near", F.collect_list("__one").over(order.rowsBetween(1 - back, 0)))
    a = left.select(*left.columns, F.col("pos").alias("__p"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__v"), F.lit(None).cast("long").alias("__l"), F.lit(None).cast(held.schema["__near"].dataType).alias("__hit"))
    b = held.select(*on, F.col("at").cast("long").alias("__p"), F.lit(0).alias("__side"), F.col("value").cast("long").alias("__v"), F.col("len").cast("long").alias("__l"), F.col("__near").alias("__hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*on).orderBy("__p", "__side", "__v", "__l")
    last = F.last("__hit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("__last", last).withColumn("__first", _first_of_key(order)).where("__side = 1")
    # (length, place in the list) decides; places count from the oldest
    holds = F.filter(F.transform("__last", lambda x, i: F.struct(x["len"].alias("l"), i.alias("i"), x.alias("x"))), lambda y: F.col("pos") < y["x"]["at"] + y["x"]["len"])
    best = F.array_max(holds)["x"]
    chosen = F.coalesce(best, F.try_element_at("__last", F.lit(-1)), F.try_element_at("__first", F.lit(1)))
    both = both.withColumn("__c", chosen)
    return both.select(*left.columns, F.col("__c.at").alias("at"), F.col("__c.len").alias("len"), F.col("__c.value").alias("value"))
