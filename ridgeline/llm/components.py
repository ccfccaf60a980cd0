"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Settled, so that joins with it have an exchange on either side and a hub's rows can be split."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge, ``root`` the least node of its component.

    A large star links a node's larger neighbours to its least one, a small star
    the smaller ones; the edges become stars in a number of rounds that is about
    the logarithm of the longest path.  Each round's aggregates and edges are
    written to the shared folder and the round's before deleted, so nothing is
    gathered, nothing is computed twice and files don't pile up.
    """
    spark = edges.sparkSession
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "stars"
    )
    before = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _least(both)
        large = both.filter("v > u").join(nearest.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, "large")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, now = now, materialize(small.filter("u != v").distinct(), "stars")
        for table in (old, nearest, large, least):
            forget(spark, table)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
