"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.staging import drop, stage


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): a staged row (node, component) for every linked node but the smallest of each component.

    In a large star every node ties its larger neighbours to the smallest it knows, in a small star the others: after
    a number of rounds that grows with the logarithm of the nodes only stars are left. Minima are aggregated
    before they are shuffled, and both sides of each join come from staged tables, so that Spark can split a node
    with very many links.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """``edges``: staged (a, b) with a > b."""
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        if large:  # an edge to a larger neighbour moves to the smallest one
            out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
        else:
            out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return stage(out.where("a != b").distinct(), "stars")

    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:  # each round leaves fewer links or the same ones, which are stars then
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        first = star(edges, True)
        nxt = star(first, False)
        drop(first)
        drop(edges)
        edges = nxt
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
