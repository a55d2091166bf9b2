"""A join by a key that may be most of one side's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined to ``values`` by ``key``, which ``values`` has once each; ``weight`` says how many of ``rows`` have it, at
    most, and is left out.

    A key with more rows than an even share of the tasks is one of fewer than there are tasks: these few values are broadcast,
    and their rows stay where they are. How the rest is joined is left to Spark, which knows the sizes. Null keys match nothing. ``values`` is read several times.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = values.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    plain = values.drop(weight)
    if most * tasks <= total:
        return rows.join(plain, key)
    hot = F.col(weight) * tasks > total
    few = values.where(hot).drop(weight)  # fewer rows than tasks
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(values.where(~hot).drop(weight), key))
