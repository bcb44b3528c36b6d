"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.operators.scratch import deleted, materialised


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that it reaches.

    Each round hangs every larger neighbour of a node under the node's smallest one, and every node's smaller neighbours under the
    smallest of them; trees flatten to stars in a logarithmic number of rounds. A node of many links is met by its minimum alone,
    which partial aggregation finds, so no node's links are gathered in one place. It is over when a round changes no link.
    """
    now, path = materialised(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    told = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if mark == told:
            low = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
            return low.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).join(low.select("id"), "id", "left_anti").distinct())
        told = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        old, (now, path) = path, materialised(small.filter("a <> b").distinct(), "links")
        deleted(links.sparkSession, old)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
