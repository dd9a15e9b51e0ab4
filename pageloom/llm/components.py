"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.session import use_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (a, b: longs); root is the smallest node it reaches.

    Each round hooks every node to its smallest neighbour; links never become more, and rounds grow
    with the logarithm of the longest path. Each round is checkpointed to the shared folder; only counts
    reach the driver. Links of a node to itself, repeated links and links
    in either direction are fine; links with a null end are left out; no links give no rows.
    """
    use_checkpoint_dir(links.sparkSession)
    links = (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct().checkpoint())
    while True:
        # large star: every larger neighbour is linked to the smallest one
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("least", "a").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        done = after.count() == links.count() and after.exceptAll(links).isEmpty()
        links = after
        if done:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
