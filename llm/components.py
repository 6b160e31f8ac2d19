"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, released


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; ``links`` has long columns a and b, the root is the least node.

    Alternates two steps until every component is a star around its least node: every node links its larger neighbours to its
    least one, then its smaller neighbours and itself to the least of them. Both are a grouped minimum and a join, so a
    node with many links is summed before the shuffle and split by the join; each round goes to the checkpoint folder.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        # in stars a node has larger neighbours only, or a single smaller one
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.count_if(F.col("b") < F.col("a")).alias("smaller")))
        if least.where("smaller > 1 or smaller = 1 and most > a").isEmpty():
            released(least)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = both.join(least.select("a", F.least("a", "m").alias("m")), "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = pairs.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).where("a != b")
        before, edges = edges, cut(small.distinct())
        released(before, least)
