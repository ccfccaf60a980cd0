"""Slope, aspect, hillshade: Horn's 3 x 3 gradients as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import NAMES
from .grid import neighbours


def gradients(df: DataFrame, resolution: float, z_factor: float = 1.0) -> DataFrame:
    """``fx`` and ``fy``; a missing neighbour counts as the cell itself."""
    near = neighbours(df.withColumn("z", F.col("z") * z_factor))
    n = {k: F.coalesce(F.col(k), F.col("z")) for k in NAMES}
    fy = (n["NW"] - n["SW"] + 2 * (n["N"] - n["S"]) + n["NE"] - n["SE"]) / (8 * resolution)
    fx = (n["SE"] - n["SW"] + 2 * (n["E"] - n["W"]) + n["NE"] - n["NW"]) / (8 * resolution)
    return near.select("raster_id", "row", "col", "z", fx.alias("fx"), fy.alias("fy"))


def _over(df: DataFrame, value: Column) -> DataFrame:
    return df.select("raster_id", "row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))


def slope(df: DataFrame, resolution: float, z_factor: float = 1.0) -> DataFrame:
    """Degrees."""
    return _over(gradients(df, resolution, z_factor), F.degrees(F.atan(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2))))


def aspect_of(fx: Column, fy: Column) -> Column:
    return 180 - F.degrees(F.atan(fy / fx)) + 90 * F.signum(fx)


def aspect(df: DataFrame, resolution: float, z_factor: float = 1.0) -> DataFrame:
    """Degrees clockwise from north; -1 where there is no east-west gradient."""
    return _over(gradients(df, resolution, z_factor), F.when(F.col("fx") != 0, aspect_of(F.col("fx"), F.col("fy"))).otherwise(-1.0))


def hillshade(df: DataFrame, resolution: float, z_factor: float = 1.0, azimuth: float = 315.0, altitude: float = 30.0) -> DataFrame:
    """Shade from 0 to 255."""
    fx, fy = F.col("fx"), F.col("fy")
    tan = F.sqrt(fx**2 + fy**2)
    az, alt = math.radians(azimuth - 90), math.radians(altitude)
    lit = tan / F.sqrt(1 + tan**2) * (math.sin(alt) / tan - math.cos(alt) * F.sin(az - F.radians(aspect_of(fx, fy))))
    value = F.when(fx != 0, lit).otherwise(0.5)
    return _over(gradients(df, resolution, z_factor), F.greatest(F.lit(0.0), F.floor(F.round(value * 255, 9)).cast("double")))


def histogram(df: DataFrame) -> DataFrame:
    return df.filter("z is not null").groupBy("raster_id", "z").agg(F.count(F.lit(1)).alias("n"))


def trimmed(hist: DataFrame, share: float = 0.01) -> DataFrame:
    """Display range of shades: from either end, the first bin by which ``share`` of all cells is reached."""
    of = W.partitionBy("raster_id")
    up, down = of.orderBy("z"), of.orderBy(F.desc("z"))
    target = F.floor(F.sum("n").over(of) * share)
    h = hist.select("raster_id", "z", F.sum("n").over(up).alias("a"), F.sum("n").over(down).alias("b"), target.alias("t"))
    # a target of no cell at all is reached in the outermost bin
    lo = F.when(F.max("t") > 0, F.min(F.when(F.col("a") >= F.col("t"), F.col("z")))).otherwise(0.0)
    hi = F.when(F.max("t") > 0, F.max(F.when(F.col("b") >= F.col("t"), F.col("z")))).otherwise(255.0)
    return h.groupBy("raster_id").agg(lo.alias("display_min"), hi.alias("display_max"))


def natural_log(df: DataFrame) -> DataFrame:
    return df.withColumn("z", F.log("z"))
