"""Connected components of a graph of any size, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    links has columns a and b. Rounds of large-star and small-star: each node's neighbours are
    tied to the smallest of them, until nothing changes. Every round is written to the shared
    folder. A hub costs no more than its links: minima are summed up before the shuffle, and
    the join that follows may be split.
    """
    edges = stored(
        links.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    known = _mark(edges)
    while known[0]:
        edges = stored(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == known:
            break
        known = now
    # Every node is now tied to its component's smallest, which is tied to nothing smaller.
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("a", "b") % 1_000_000_007),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties the larger neighbours of each node to the smallest of all, itself included."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them. Here a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).filter("a != b").distinct()
