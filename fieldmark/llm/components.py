"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.staging import stage


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for links (a, b) of longs.

    Only nodes other than the smallest of their component are listed. Each round points a node's larger
    neighbours at the smallest one, then its smaller neighbours; after a number of rounds that grows
    with the logarithm of the longest path nothing changes. A node may have any number of links: minima
    are combined before the shuffle, and the join back can be split. Every round is written, which cuts
    the lineage.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
        both = edges.unionAll(edges.select(F.col("component").alias("node"), F.col("node").alias("component")))
        least = both.groupBy("node").agg(F.min("component").alias("m"))
        large = (
            both.join(least, "node")
            .where(F.col("component") > F.col("node"))
            .select(F.col("component").alias("node"), F.least("m", "node").alias("component"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("component").alias("m"))
        small = (
            large.join(least, "node")
            .select("m", F.explode(F.array("node", "component")).alias("node"))
            .where(F.col("node") > F.col("m"))
            .select("node", F.col("m").alias("component"))
            .distinct()
        )
        edges = stage(small)
