"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.session import settle


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour, or to the node."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.join(_least(both), "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """The node and its smaller neighbours are all tied to the least of them (links run down)."""
    joined = links.join(_least(links), "a")
    return (
        joined.select("a", F.col("least").alias("b"))
        .unionByName(joined.filter("b <> least").select(F.col("b").alias("a"), "least").toDF("a", "b"))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node reachable, for every node of ``links`` (a, b).

    Each round is a few equality joins and map-side combined aggregates; the link table
    never grows. Rounds end when a star is all that is left of each component, after
    about the logarithm of the longest path. Every round is stored in the shared folder,
    so a lost executor repeats one round at most. Starts jobs.
    """
    links = settle(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    while True:
        links = settle(_small_star(_large_star(links)), "stars")
        new = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return nodes.unionByName(nodes.select(F.col("least").alias("node"), "least")).distinct()
