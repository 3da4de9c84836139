"""Connected components of a frame of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwatch.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the component's smallest node) of every node of links.

    Each round gives every component the smallest of its neighbours', follows
    that twice, and keeps only links between components that still differ, so
    that the links shrink fast.  Nothing is collected.  Links are short rows:
    what they give is written in as many files as their number needs.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    most = 2 * both.count()
    both = cut(both.union(both.select("y", "x")).filter("x <> y").distinct(), most)
    nodes = None
    while nodes is None or not both.isEmpty():
        step = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")), most)
        # Follow the step: where its target moves on too, go there.
        ahead = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = cut(step.join(ahead, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), most)
        ahead = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        nodes = step if nodes is None else cut(nodes.join(ahead, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), most)
        left, right = step.select(F.col("node").alias("x"), F.col("comp").alias("cx")), step.select(F.col("node").alias("y"), F.col("comp").alias("cy"))
        both = cut(both.join(left, "x").join(right, "y").filter("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), most)
    return nodes
