"""Summaries of benchmark timings: nearest-rank and interpolated percentiles, the window law, fits, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The smallest value that ``p`` percent of a group's values don't pass, for each p."""
    kind = dict(df.dtypes)[value]  # the values' own type: they are values of the group
    return df.groupBy(*by).agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"p{p}") for p in percents))


def decode_rate(runs: DataFrame, warmups: int = 3) -> DataFrame:
    """``runs(label, run, bases, ns)`` -> ``(label, d_q)``: the median bases per ns of the runs after the warm-ups."""
    return runs.where(F.col("run") >= warmups).groupBy("label").agg(F.median(F.col("bases") / F.col("ns")).alias("d_q"))


def window_law(timings: DataFrame, rates: DataFrame, q: int) -> DataFrame:
    """Is a window's time c0 + (W + Q - 1) / D_Q, with c0 = p50(1) - Q / D_Q? Passes if c0 >= 0 and every error is within 20 %."""
    p50 = nearest_rank(timings, ["label", "w"], "ns", (50,))
    one = p50.where("w = 1").select("label", F.col("p50").alias("first"))
    rows = p50.join(one, "label").join(rates, "label").withColumn("c0", F.col("first") - q / F.col("d_q"))
    rows = rows.withColumn("predicted", F.col("c0") + (F.col("w") + q - 1) / F.col("d_q"))
    rows = rows.withColumn("error_pct", 100 * (F.col("predicted") - F.col("p50")) / F.col("p50"))
    return rows.select("label", "w", "p50", "d_q", "c0", "predicted", "error_pct", ((F.col("c0") >= 0) & (F.abs("error_pct") <= 20)).alias("pass"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, mean, least, most, and the value at index int(0.9 * (n - 1)) of the sorted ones."""
    group = W.partitionBy(*by)
    df = df.withColumn("__i", F.row_number().over(group.orderBy(value))).withColumn("__n", F.count("*").over(group))
    at = F.max(F.when(F.col("__i") == F.floor(0.9 * (F.col("__n") - 1)) + 1, F.col(value)))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), at.alias("p90"))


def pivot(df: DataFrame, by: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(by).pivot(column, values).agg(F.median(value))


def interpolated(df: DataFrame, by: list[str], value: str, p: float = 0.9) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile(value, p).alias("p"), (F.max(value) / F.min(value)).alias("spread"))


def fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y = alpha + beta * x by least squares."""
    return df.groupBy(*by).agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"))
