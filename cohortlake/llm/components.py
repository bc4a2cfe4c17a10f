"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import settled


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star operation: hang the neighbours of every node on the least of them.

    The large one moves the neighbours above the node, the small one the node and its
    neighbours below it.  Least neighbours are aggregated before the join, so a node with
    very many links is no task of its own.
    """
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        below = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = below.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; root is the least node reachable.

    Alternates large-star and small-star operations until the links are stars.  Every
    round is checkpointed.  Links to oneself, repeated, reversed and null links change
    nothing; nodes without a link are not returned; no links give no rows.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = settled(now), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        now = settled(_stars(_stars(now, large=True), large=False))
    else:
        raise RuntimeError(f"links are not stars after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
