"""Neighbourhood statistics over boxes, by two passes of running sums, or by tiles with a margin."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import beside, box_sums, by_col, by_row, extremes, running, with_small
from .stats import fine_bin, regrouped


def mean_filter(df: DataFrame, size_x: int = 3, size_y: int | None = None) -> DataFrame:
    size_y = size_x if size_y is None else size_y
    if size_x % 2 == 0 or size_y % 2 == 0 or min(size_x, size_y) < 1:
        raise ValueError("filter sizes must be odd")
    s = box_sums(df, {"s": F.col("z"), "n": F.col("z").isNotNull().cast("long")}, size_x // 2, size_y // 2)
    return s.select("raster_id", "row", "col", F.when(F.col("z").isNotNull(), F.col("s") / F.col("n")).alias("z"))


def _shifted(df: DataFrame, shift: Column) -> DataFrame:
    """``z`` less a number of its grid, for sums that keep their digits."""
    return with_small(df, extremes(df).select("raster_id", shift.alias("_k")), ["raster_id"]).withColumn("z", F.col("z") - F.col("_k")).drop("_k")


def _middle() -> Column:
    return F.col("min_z") + (F.col("max_z") - F.col("min_z")) / 2


def _inner() -> Column:
    """The first row and column belong to no box."""
    return (F.col("row") > 0) & (F.col("col") > 0) & F.col("z").isNotNull()


def _moments(df: DataFrame, radius: int, counted: Column) -> DataFrame:
    z = F.col("z")
    sums = {"s": F.when(counted, z).otherwise(0.0), "q": F.when(counted, z * z).otherwise(0.0), "n": counted.cast("long")}
    return box_sums(df, sums, radius, radius)


def _score(least: int = 0, otherwise: float | None = 0.0) -> Column:
    s, q, n = F.col("s"), F.col("q"), F.col("n")
    v = (q - s * s / n) / n
    good = (n > least) & (v > 0)
    return F.when(F.col("z").isNotNull(), F.when(good, (F.col("z") - s / n) / F.sqrt(v)).otherwise(F.lit(otherwise).cast("double")))


def deviation_from_mean(df: DataFrame, radius: int = 1) -> DataFrame:
    m = _moments(_shifted(df, _middle()), radius, _inner())
    return m.select("raster_id", "row", "col", _score().alias("z"))


def deviation_from_mean_traditional(df: DataFrame, radius: int = 1) -> DataFrame:
    """The symmetric box, with more than two cells."""
    m = _moments(_shifted(df, _middle()), radius, F.col("z").isNotNull())
    return m.select("raster_id", "row", "col", _score(2).alias("z"))


def difference_from_mean(df: DataFrame, radius: int = 1) -> DataFrame:
    m = _moments(_shifted(df, F.col("min_z")), radius, _inner())
    value = F.when(F.col("n") > 0, F.col("z") - F.col("s") / F.col("n")).otherwise(0.0)
    return m.select("raster_id", "row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))


def max_elevation_deviation(df: DataFrame, least: int = 1, most: int = 3, step: int = 1) -> DataFrame:
    """``magnitude`` and ``scale``: the largest deviation over radii, the smallest radius on ties; null where none is defined.

    All radii share the two exchanges: each pass computes every radius's frames.
    """
    radii = list(range(least, most + 1, step))
    z, counted = F.col("z"), _inner()
    parts = {"s": F.when(counted, z).otherwise(0.0), "q": F.when(counted, z * z).otherwise(0.0), "n": counted.cast("long")}
    flat = _shifted(df, _middle()).select(
        "raster_id", "row", "col", "z", *[running(e, by_row(), r).alias(f"{k}{r}") for r in radii for k, e in parts.items()]
    )
    full = flat.select("raster_id", "row", "col", "z", *[running(f"{k}{r}", by_col(), r).alias(f"{k}{r}") for r in radii for k in parts])
    found = []
    for r in radii:
        s, q, n = F.col(f"s{r}"), F.col(f"q{r}"), F.col(f"n{r}")
        v = (q - s * s / n) / n
        d = (z - s / n) / F.sqrt(v)
        found.append(F.when((n > 0) & (v > 0) & z.isNotNull(), F.struct(F.abs(d).alias("a"), F.lit(-r).alias("r"), d.alias("d"))))
    best = F.array_max(F.array(*found))
    return full.select("raster_id", "row", "col", best["d"].alias("magnitude"), (-best["r"]).cast("double").alias("scale"))


def elevation_percentile(df: DataFrame, radius: int = 1, bins: int = 1, side: int = 256) -> DataFrame:
    """Where a cell stands among its box's cells, by ``bins`` groups of about equally many cells of the grid.

    Tiles with a margin of ``radius`` (a tile is never narrower than its margins)
    count each group by an integral image, so neither many groups nor a large
    radius make the plan or a task's memory grow beyond a tile's cells.
    """
    tagged = fine_bin(df)
    cells = with_small(tagged, regrouped(tagged, bins), ["raster_id", "fine"], "left")  # 10 000 rows a grid at most
    side = max(side, 2 * radius)
    for name, c in (("tr", "row"), ("tc", "col")):
        of = [F.floor((F.col(c) + d) / side).cast("int") for d in (-radius, 0, radius)]
        cells = cells.withColumn(name, F.explode(F.array_distinct(F.array(*of))))

    def count(p: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        row, col = p["row"].to_numpy() - tr * side, p["col"].to_numpy() - tc * side
        own = (row >= 0) & (row < side) & (col >= 0) & (col < side)
        group = p["bin"].to_numpy(np.float64)
        counted = ~np.isnan(group) & (p["row"].to_numpy() > 0) & (p["col"].to_numpy() > 0)
        size = side + 2 * radius + 1
        row, col = row + radius + 1, col + radius + 1  # the first row and column of an integral image are zero
        less, same, total = (np.zeros(int(own.sum())) for _ in range(3))
        mine = np.nan_to_num(group[own], nan=-1)
        r, c = row[own], col[own]
        for k in range(bins):
            one = np.zeros((size, size), np.int32)
            at = counted & (group == k)
            one[row[at], col[at]] = 1
            image = one.cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)
            a, b, x, y = r - radius - 1, r + radius, c - radius - 1, c + radius
            n = image[b, y] - image[a, y] - image[b, x] + image[a, x]
            total += n
            less += n * (mine > k)
            same += n * (mine == k)
        with np.errstate(divide="ignore", invalid="ignore"):
            z = 100.0 * (less + p["prob"].to_numpy(np.float64)[own] * same) / total
        z = np.where((total > 0) & (mine >= 0), z, np.nan)
        return pd.DataFrame({"raster_id": p["raster_id"][own], "row": p["row"][own], "col": p["col"][own], "z": pd.Series(z, index=p.index[own])})

    got = cells.select("raster_id", "row", "col", "tr", "tc", "bin", "prob").groupBy("raster_id", "tr", "tc").applyInPandas(count, "raster_id string, row int, col int, z double")
    return got.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def fill_small_nodata_holes(df: DataFrame, compat: bool = False) -> DataFrame:
    """No-data between two valid cells gets their mean: first above and below, then left and right.

    ``compat`` blanks the first and the last row before the second pass.
    """
    mean = (beside("z", "row", -1, by_col()) + beside("z", "row", 1, by_col())) / 2
    one = df.select("raster_id", "row", "col", F.coalesce(F.col("z"), mean).alias("z"))
    if compat:
        last = df.groupBy("raster_id").agg(F.max("row").alias("_last"))
        inside = (F.col("row") > 0) & (F.col("row") < F.col("_last"))
        one = with_small(one, last, ["raster_id"]).select("raster_id", "row", "col", F.when(inside, F.col("z")).alias("z"))
    mean = (beside("z", "col", -1, by_row()) + beside("z", "col", 1, by_row())) / 2
    return one.select("raster_id", "row", "col", F.coalesce(F.col("z"), mean).alias("z"))
