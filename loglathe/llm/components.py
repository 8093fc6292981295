"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a fixed number of shuffles over the edges and ends in a table in the shared folder; what
reaches the driver is one number a round.  Each node of a round is pre-aggregated to its smallest
neighbour, so a hub is no collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept


def _summary(edges: Kept) -> tuple:
    return tuple(edges.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """edges (a, b: longs; at most ``most``, if given) -> (id, component_id) of every node with an edge; the smallest id names a component."""
    # (u, v) with u > v: v is a smaller node of the same component
    now = Kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", most)
    before = _summary(now)
    for _ in range(rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of u go to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        tied = star.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        new = Kept(tied.where("u > v").distinct(), "edges", before[0])  # a round makes no more edges than there were
        after = _summary(new)
        now.drop()
        now = new
        if before == after:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ends = now.df.select("v").distinct()
    return now.df.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        ends.select(F.col("v").alias("id"), F.col("v").alias("component_id"))
    )
