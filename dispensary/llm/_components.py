"""Connected components by alternating large-star and small-star steps, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispensary.llm._spark import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(cls, label) for every end of a link (a, b); the label is the smallest end of its component.

    Each round hangs every node's neighbours on the smallest of them, until the links are stars around the smallest
    nodes.  A node with very many neighbours is only ever aggregated (in parts) or joined, never gathered."""
    edges = checkpointed(links.select(F.least("a", "b").alias("m"), F.greatest("a", "b").alias("v")).filter("m != v").distinct())
    while True:  # a round that is not the last one changes links, and labels only get smaller
        # stars: no node hangs on two others, or on one and has others hanging on it
        centres, ends = edges.select("m").distinct().withColumnRenamed("m", "v"), edges.groupBy("v").count()
        if ends.filter("count > 1").select("v").unionByName(ends.select("v").join(centres, "v", "left_semi")).isEmpty():
            break
        # large star: the larger neighbours of a node hang on the smallest node around it
        both = edges.select(F.col("m").alias("u"), F.col("v").alias("w")).unionByName(edges.select(F.col("v").alias("u"), F.col("m").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("w0")).select("u", F.least("u", "w0").alias("m"))
        large = both.join(least, "u").filter("w > u").select("m", F.col("w").alias("v"))
        # small star: a node and its smaller neighbours hang on the smallest of these
        least = large.groupBy("v").agg(F.min("m").alias("m0"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m0").alias("m"), "v"), F.struct(F.col("m0").alias("m"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("m != v").distinct()
        edges = checkpointed(small)
    return edges.select(F.col("v").alias("cls"), F.col("m").alias("label")).unionByName(edges.select(F.col("m").alias("cls"), F.col("m").alias("label")).distinct())
