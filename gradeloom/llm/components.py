"""Connected components of a link table by alternating star contractions.

Every round replaces the links of a node by links to its smallest neighbour,
first on the larger side, then on the smaller; the links end as stars around
the smallest node of each component. Minima are aggregates with a map side
and joins on the node, so a node of many links is split by adaptive skew
joins; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import kept_table


def _towards_smallest(links: DataFrame) -> DataFrame:
    """One round over links (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(smallest, "a")
    return (small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and isn't its own root.

    `links` has two bigint columns a, b; direction, repetition, self-links and nulls don't matter.
    """
    links = kept_table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(links)
    while True:
        links = kept_table(_towards_smallest(links), "links")
        now = _state(links)
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
