"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller neighbours, first for the larger
ends of every node's links, then for the smaller ones, until a round leaves the
table as it was; the number of rounds grows with the logarithm of the longest
chain.  A node's neighbours are only ever reduced to a minimum, which combines
before the shuffle, and links stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """``links``: long columns a, b.  Returns node, component: the smallest node
    reachable; nodes without a link to another are left out.  The caller may
    ``release`` the result."""
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    many = edges.count()
    while True:
        # Large star: every neighbour above u, and u itself, hangs on u's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u's smaller neighbours, and u, hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(low, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        after = materialise(small.filter("u <> v").distinct(), "links")
        now = after.count()
        same = now == many and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        release(edges)
        if same:
            out = after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            out.scratch_path = after.scratch_path
            return out
        edges, many = after, now
