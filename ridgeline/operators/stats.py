"""Histograms of 10 000 fine bins, quantile classes and percentile groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import extremes, with_small

FINE = 10_000


def fine_bin(df: DataFrame) -> DataFrame:
    """``df`` with ``fine``: the cell's bin of the grid's range, rounded up to whole units; a flat grid has one bin."""
    ends = extremes(df).select("raster_id", "min_z", (F.ceil(F.col("max_z") - F.col("min_z")) / FINE).alias("_size"))
    at = F.least(F.floor((F.col("z") - F.col("min_z")) / F.col("_size")), F.lit(FINE - 1))
    fine = F.when(F.col("z").isNotNull(), F.when(F.col("_size") > 0, at).otherwise(0)).cast("int")
    return with_small(df, ends, ["raster_id"]).withColumn("fine", fine).drop("min_z", "_size")


def quantiles(df: DataFrame, bins: int = 1) -> DataFrame:
    """Classes 1 to ``bins`` by the share of cells at or below the cell's fine bin."""
    tagged = fine_bin(df)
    hist = tagged.filter("fine is not null").groupBy("raster_id", "fine").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy("raster_id")
    share = 100.0 * F.sum("n").over(of.orderBy("fine")) / F.sum("n").over(of)
    cls = F.least(F.floor(share / (100.0 / bins)), F.lit(bins - 1)) + 1
    classes = hist.select("raster_id", "fine", cls.cast("double").alias("class"))
    out = with_small(tagged, classes, ["raster_id", "fine"], "left")
    return out.select("raster_id", "row", "col", F.col("class").alias("z"))


def greedy_groups(counts: dict[int, int], bins: int) -> list[tuple[int, int, float]]:
    """(fine bin, group, share of the group up to it) for the fine bins that hold cells.

    Bins are taken in order; a group closes when its running count passes an
    equal share of all cells.  The walk also visits empty bins: after a bin that
    alone is over the share, each closes a group.
    """
    quota = sum(counts.values()) // bins
    group, running, held, seen = 0, 0, {}, []
    for k in range(FINE):
        n = counts.get(k, 0)
        running += n
        if running > quota and group < bins - 1:
            group, running = group + 1, n
        held[group] = held.get(group, 0) + n
        if n:
            seen.append((k, group, running))
    return [(k, g, r / held[g]) for k, g, r in seen]


def regrouped(tagged: DataFrame, bins: int) -> DataFrame:
    """``(raster_id, fine, bin, prob)``; the histogram of a grid has at most 10 000 rows and is walked in order."""
    import pandas as pd

    hist = tagged.filter("fine is not null").groupBy("raster_id", "fine").agg(F.count(F.lit(1)).alias("n"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy_groups(dict(zip(pdf["fine"], pdf["n"], strict=True)), bins)
        return pd.DataFrame([(pdf["raster_id"].iloc[0], *g) for g in got], columns=["raster_id", "fine", "bin", "prob"])

    return hist.groupBy("raster_id").applyInPandas(walk, "raster_id string, fine int, bin int, prob double")
