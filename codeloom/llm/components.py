"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored


def components(links: DataFrame, most: int = 50) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) the smallest node it is connected to.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of its neighbourhood, so
    paths fold up and rounds grow with the logarithm of their length. A round's links are written to shared storage;
    a fixed point is told by their number and a sum of hashes. A hub's links are told its least neighbour by a join
    that may be split, never gathered in one list.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = edges.join(low, "a").select("a", F.col("low").alias("b"))
        large = large.union(own).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links were not folded after {most} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select("root", "root").distinct()).toDF("node", "root")
