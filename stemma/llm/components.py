"""Connected components by minimum labels with shortcuts, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b); their directions don't matter.

    Each round takes the smallest label among neighbours, then the label's own label, and is written to the shared
    folder. An edge's ends are joined with the table of labels; no task sees a whole component.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("lower"))
        owner = labels.select(F.col("node").alias("o"), F.col("component").alias("owned"))
        moved = written(lower.join(owner, F.col("lower") == F.col("o"), "left").select("node", "was", F.least("lower", "owned").alias("component")), "labels")
        dropped(labels)
        labels = moved
        if moved.where(F.col("was") != F.col("component")).isEmpty():
            dropped(both)
            out = moved.select("node", "component")
            out._stemma_path = moved._stemma_path
            return out
