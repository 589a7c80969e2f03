"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldbook.llm.job import beside, cut, released


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Each round hangs the neighbours of every node on the smallest of them, first the larger ones, then the smaller
    ones.  Links only shrink to stars, so rounds grow with the logarithm of the longest path; only two columns of ids
    move, and sums per node are combined before the shuffle.  The larger neighbours of a hub are dealt over many tasks.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = released(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))).collect()[0]
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (beside(both, ["a"], ["b"], F.min("b"), F.min, "least").where("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
