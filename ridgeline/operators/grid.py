"""Grids as cell tables: making them, neighbours, box sums.

Every focal operator here uses two window exchanges, one by row and one by
column.  A task holds one line of a grid, never a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import NAMES
from ..session import settled


def by_row():
    return W.partitionBy("raster_id", "row").orderBy("col")


def by_col():
    return W.partitionBy("raster_id", "col").orderBy("row")


def from_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 10000, raster_id: str = "dem") -> DataFrame:
    """A grid of whole numbers from a table of vectors: a row for each vector, a column for each component."""
    cells = df.select(F.col(id_col).cast("int").alias("row"), F.posexplode(vec_col).alias("col", "x"))
    return cells.select(F.lit(raster_id).alias("raster_id"), "row", "col", F.round(F.col("x").cast("double") * scale).cast("double").alias("z"))


def new_grid(spark: SparkSession, rows: int, cols: int, initial: float | None = None, raster_id: str = "new") -> DataFrame:
    ids = spark.range(rows * cols)
    return ids.select(
        F.lit(raster_id).alias("raster_id"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"),
        F.lit(initial).cast("double").alias("z"),
    )


def beside(value: str | Column, place: str, step: int, window) -> Column:
    """The value ``step`` cells further in a window, null if that cell isn't in the table."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.lag(place, -step).over(window) == F.col(place) + step, F.lag(value, -step).over(window))


def neighbours(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the eight neighbours' values in columns NE, E, ... N; absent cells and no-data are null."""
    flat = df.select("raster_id", "row", "col", "z", *keep).withColumns({"W": beside("z", "col", -1, by_row()), "E": beside("z", "col", 1, by_row())})
    up = {"N": beside("z", "row", -1, by_col()), "NW": beside("W", "row", -1, by_col()), "NE": beside("E", "row", -1, by_col())}
    down = {"S": beside("z", "row", 1, by_col()), "SW": beside("W", "row", 1, by_col()), "SE": beside("E", "row", 1, by_col())}
    return flat.withColumns(up | down).select("raster_id", "row", "col", "z", *keep, *NAMES)


def running(value: str | Column, window, radius: int) -> Column:
    """The sum within ``radius`` on either side, as the difference of two running sums: the cost doesn't grow with the radius."""
    value = F.col(value) if isinstance(value, str) else value
    upto = lambda end: F.coalesce(F.sum(value).over(window.rangeBetween(W.unboundedPreceding, end)), F.lit(0))
    return upto(radius) - upto(-radius - 1)


def box_sums(df: DataFrame, sums: dict[str, Column], rx: int, ry: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sums of expressions (null counts as 0) over the box of ``rx`` columns and ``ry`` rows on either side, clipped at the edges."""
    flat = df.select("raster_id", "row", "col", "z", *keep, *[running(e, by_row(), rx).alias(k) for k, e in sums.items()])
    return flat.select("raster_id", "row", "col", "z", *keep, *[running(k, by_col(), ry).alias(k) for k in sums])


BROADCAST_ROWS = 100_000


def with_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of few rows a grid: settled, counted, and only broadcast if it is small, for there may be very many grids."""
    small = settled(small)
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def prefix_sums(df: DataFrame, value: Column, name: str = "s") -> DataFrame:
    """The integral image: for each cell the sum over all cells at or before it in both directions."""
    row = by_row().rowsBetween(W.unboundedPreceding, 0)
    col = by_col().rowsBetween(W.unboundedPreceding, 0)
    flat = df.select("raster_id", "row", "col", "z", F.sum(value).over(row).alias(name))
    return flat.withColumn(name, F.sum(name).over(col))


def extremes(df: DataFrame) -> DataFrame:
    """A row for each grid: least and greatest value, without no-data, and how many cells have one."""
    return df.groupBy("raster_id").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.count("z").alias("n_valid"), F.count(F.lit(1)).alias("n_cells"))
