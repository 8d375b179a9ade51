"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import cleared, stored


def components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) to (node, component): the smallest node reachable, for each node with a link.

    Each step takes the least neighbour of every node (a partial aggregate, so a node with very many
    links is summed before it is shuffled) and joins it back, where adaptive execution splits such a
    node. Links between a node and itself, repeated links and links with nulls count as none.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    before = None
    while True:  # each round shortens the paths; the number of rounds grows with the logarithm of the longest
        both = edges.select("v", "u").unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # every edge now goes from a node to a smaller one
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        old, edges = edges, stored(small.unionAll(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cleared(old)
        if state == before:
            break
        before = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )
