"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), b < a: link each node's larger (or not larger) neighbours to its least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        # A node that is least among its own keeps its edges as they are: hubs are never joined.
        least = least.where("m < a")
        moved = both.join(least, "a", "left").where("b > a").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
    else:
        moved = both.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return moved.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node on an edge (a, b), b < a; root is the component's least node.

    Each round is written to the shared folder. Rounds grow with the logarithm of a component's size; the loop ends
    when a round changes nothing and raises if `rounds` do not reach that.
    """
    now = common.keep(edges.select("a", "b"), "edges")
    mark = None
    for _ in range(rounds):
        now = common.keep(stars(stars(now, True), False), "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        mark = new
    raise RuntimeError("components did not settle")
