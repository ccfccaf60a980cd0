"""Grid and point-cloud formats as Spark data sources."""

from .datasource import read_raster, register, write_raster
from .errors import RasterError

__all__ = ["RasterError", "read_raster", "register", "write_raster"]
