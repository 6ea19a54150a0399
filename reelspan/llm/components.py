"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the component's smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until all links are stars.
    Each step is one aggregate and one join on the node; a hub's links are rows, never one collected
    list. The tables between steps are written to the shared folder.
    """
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = scratch.write(small, "links")
        # Done when every node hangs on one other that hangs on none.
        roots = now.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(1))
        open_nodes = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(roots.hint("merge"), "a", "left").where("n > 1 or root = 1")
        if open_nodes.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
