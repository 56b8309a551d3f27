"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for all nodes of ``edges`` (a, b; integers).

    Large-star and small-star rounds: every node links its neighbours to the smallest node it sees. Only minima per node are taken, so a
    node with very many neighbours is combined before the shuffle; each round is stored, and rounds grow with the logarithm of the longest
    chain.
    """
    links = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the smallest node next to it
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        found = cut_lineage(small)
        if _same(links, found):
            break
        links = found
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Equal sets of links, by number and sums of hashes."""
    total = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    return a.agg(*total).first() == b.agg(*total).first()
