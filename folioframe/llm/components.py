"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators.tables import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id that its edges reach) of every end of an edge.

    Every round takes each vertex to the smallest label around it and then to that label's own label, so the labels'
    paths halve; the rounds are about the logarithm of the longest path. Each round's labels are written to the shared
    folder. Only counts come to the driver. Edges with a null end are left out; an empty table gives no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = stored(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lowered = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("u").alias("new"), F.col("label").alias("far"))
        moved = lowered.join(jump, "new", "left").select("u", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("was"))
        after = stored(moved, "labels")
        labels = after.select("u", "label")
        if not after.where("label <> was").limit(1).count():
            return labels.select(F.col("u").alias("id"), F.col("label").alias("component"))
