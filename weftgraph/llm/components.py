"""Connected components of an edge table by hooking to the smallest neighbour and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges(a, b): c is the smallest vertex of v's component.

    Each round moves labels over one edge and then halves the paths to the smallest label; rounds
    are cut off by checkpoints on shared storage and end when no label changes."""
    shared_dir(edges.sparkSession)  # where the checkpoints go
    # both directions of an edge come from one pass over what made it
    both = edges.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        hooked = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("hook"))
        jumped = hooked.join(labels.select(F.col("v").alias("hook"), F.col("c").alias("top")), "hook").select("v", "old", F.least("hook", "top").alias("c")).checkpoint()
        changed = jumped.where("c <> old").limit(1).count()
        labels = jumped.select("v", "c")
        if not changed:
            return labels
