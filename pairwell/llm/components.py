"""Connected components by alternating large and small stars, on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, save

#: Rounds after which a graph without progress counts as an error; stars halve depths each round.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each neighbour of u that is larger (large) or not larger (small) is hung to the least."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    joined = sides.join(least, sides["u"] == least["mu"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("mu <> m").select(F.col("mu").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) of every node that isn't its component's root.

    edges: u, v (longs, undirected; loops and repeats are allowed). Every round is written to the
    shared folder and the one before deleted, so nothing but its size and a checksum comes to the
    driver. The result is such a table (see runtime.drop). A hub's edges are summed before the shuffle
    that finds its least neighbour; the join back to them is one that adaptive execution splits.
    """
    edges = save(edges.select("u", "v").where("u <> v").distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
        if now[0] == 0 or now == mark:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            found.saved_at = edges.saved_at
            return found
        mark = now
        before, edges = edges, save(_star(_star(edges, True), False))
        drop(before)
    raise RuntimeError("components did not settle")
