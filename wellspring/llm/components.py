"""Connected components of a graph given as pairs of longs, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm._common import cut


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest member, for every node of ``pairs`` (a, b).

    Each round lets every node point to the smallest node next to it, follows the pointers twice and contracts the graph along them; at least half of the
    nodes that are not alone go, so the rounds grow with the logarithm of the longest chain. Only aggregations and joins on nodes move data, and each
    round's graph and pointers are kept in the checkpoint folder.
    """
    edges = cut(pairs.where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to"))
        step = cut(_follow(_follow(step)))
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = step
        else:
            next_step = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
            labels = cut(labels.join(next_step, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
    return labels.select("node", F.col("to").alias("component"))


def _follow(step: DataFrame) -> DataFrame:
    onward = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
    return step.join(onward, "to").select("node", F.col("further").alias("to"))
