"""Schemas, geometry and the neighbour order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_FIELDS = "raster_id string, row int, col int, z double"
META_FIELDS = (
    "raster_id string, path string, format string, rows int, cols int, north double, south double, east double, west double, nodata double, "
    "data_type string, epsg int, crs_wkt string, z_units string, xy_units string, palette string, palette_nonlinearity double, display_min double, "
    "display_max double, n_bands int, photometric int, byte_order string, pixel_is_area boolean, reflect_at_boundaries boolean, metadata array<string>"
)
POINT_FIELDS = (
    "file string, n long, x double, y double, z double, intensity int, return_number int, number_of_returns int, scan_direction boolean, "
    "edge_of_flightline boolean, class_value int, class_name string, synthetic boolean, key_point boolean, withheld boolean, scan_angle int, "
    "user_data int, point_source_id int"
)
TAG_FIELDS = "path string, section string, code int, name string, dtype string, count long, value string, keyword string"

# neighbours in the order NE, E, SE, S, SW, W, NW, N (fixed values)
NAMES = ("NE", "E", "SE", "S", "SW", "W", "NW", "N")
DX = (1, 1, 1, 0, -1, -1, -1, 0)
DY = (-1, 0, 1, 1, 1, 0, -1, -1)

GEOGRAPHIC_EPSG = (4322, 4326, 4629, 4277)  # fixed values
DEGREE = 113200  # metres, for the conversion of heights (fixed value)


def cell_size_x() -> Column:
    return (F.col("east") - F.col("west")) / F.when(F.col("pixel_is_area"), F.col("cols")).otherwise(F.col("cols") - 1)


def cell_size_y() -> Column:
    return (F.col("north") - F.col("south")) / F.when(F.col("pixel_is_area"), F.col("rows")).otherwise(F.col("rows") - 1)


def grid_resolution() -> Column:
    return (cell_size_x() + cell_size_y()) / 2


def is_geographic() -> Column:
    wkt, units = F.lower(F.coalesce(F.col("crs_wkt"), F.lit(""))), F.lower(F.coalesce(F.col("xy_units"), F.lit("")))
    return F.col("epsg").isin(*GEOGRAPHIC_EPSG) | ~wkt.contains("projcs[") | units.contains("deg")


def z_conversion(compat: bool = False, geographic: bool | None = None) -> Column:
    """Factor for heights over geographic coordinates; ``compat`` takes half the extent for the middle latitude,
    ``geographic`` overrides what the projection says."""
    mid = (F.col("north") - F.col("south")) / 2 if compat else (F.col("north") + F.col("south")) / 2
    factor = F.when(F.abs(mid) <= 90, 1 / (DEGREE * F.cos(F.radians(mid)))).otherwise(1.0)
    degrees = F.coalesce(is_geographic(), F.lit(False)) if geographic is None else F.lit(geographic)
    return F.when(degrees, factor).otherwise(1.0)
