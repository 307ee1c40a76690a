"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round groups with partial aggregation and joins (which adaptive execution splits at hot nodes);
its result is a table in the shared folder, so lineage stays short and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v, distinct). Large: larger neighbours of u go to the least of u's neighbourhood; small: the smaller ones and u do."""
    ways = links.select("u", "v")
    if large:
        ways = ways.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ways.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for every node of links (columns a, b) that isn't the least itself."""
    now = stage(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        now = stage(_star(_star(now, True), False), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = seen
