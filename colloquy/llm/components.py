"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``, whole numbers), written.

    The component is the smallest node that can be reached. Each step sends a node's neighbours
    to the smallest of them, as a grouped minimum (which combines before the shuffle) joined back. The
    join is dealt by node and Spark can't split it below an aggregate, so that the links of one node,
    three narrow numbers each, are one task's. The number of steps grows with the
    logarithm of the number of nodes. With fewer ``steps``, a node may have a larger node of its
    component, in several rows; as links, the rows then still connect what ``links`` connects.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before, turn = None, 0
    while turn != steps:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v")))
        after = written(small.distinct())
        discard(edges)
        edges, turn = after, turn + 1
        if steps is None:
            # Stars are stable: every edge ends at its component's smallest node.
            count = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if count == before:
                break
            before = count
    least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least))
    discard(edges)
    return found
