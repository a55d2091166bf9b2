"""Connected components by minimum labels and pointer jumping, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(v, label)``: for each vertex that has an edge, the smallest vertex it can reach.

    Each round takes the neighbours' smallest label and then the label's own label, so that rounds grow with the
    logarithm of a component's diameter in the usual case. Labels live in scratch tables; the driver sees one count
    a round. A label that most vertices have is one row on its side of a join of longs, whose other side adaptive execution splits. No edges: no rows.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = scratch.save(step, "step")
        up = step.select(F.col("v").alias("u"), F.col("label").alias("up"))
        jumped = scratch.save(step.join(up, step.label == up.u).select("v", "was", F.least("label", "up").alias("label")), "labels")
        changed = not jumped.where("label <> was").isEmpty()
        scratch.drop(step, labels)
        labels = jumped
        if not changed:
            scratch.drop(both)
            return labels.select("v", "label")
