"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialise


def _minimum(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("x").agg(F.min("y").alias("m"))


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node with a link in `links` (a, b long); the root is the smallest node reachable.

    Each round is written to the shared folder. A hub with many links is one row of minima joined to its links, which
    adaptive execution may split; nothing is gathered by node.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = materialise(pairs, "links")
    seen = _mark(now)
    while seen[0]:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = _minimum(both).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        below = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        low = _minimum(below)
        small = below.join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("x", "m")).distinct()
        now = materialise(small, "links")
        before, seen = seen, _mark(now)
        if seen == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
