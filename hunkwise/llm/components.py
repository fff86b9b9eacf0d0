"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm import common


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a bigint, b bigint); component is the smallest node reachable.

    Each round, a node's larger neighbours and then its smaller ones are linked to the smallest of all; rounds are logarithmic
    in number. Rounds are written to the shared folder. Degrees may be skewed: minima are summed before the shuffle, and the
    joins have a side with one row per node, so that the other may be split.
    """
    edges = common.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != mark and now[0]:
        mark = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", "m"))
        edges = common.stored(small.distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
