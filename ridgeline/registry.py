"""The tools by name: what they take, what they say, and running them on files."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, model
from .operators import flow, focal, hydro, local, points, stats
from .sources import datasource
from .sources.formats import EXTENSIONS, codec, is_supported

NAME_LENGTH, DESCRIPTION_LENGTH = 20, 55


@dataclass
class Argument:
    name: str
    kind: type
    text: str
    default: object = None


@dataclass
class Tool:
    name: str
    text: str
    arguments: list[Argument]
    run: Callable
    outputs: int = 1
    aliases: list[str] = field(default_factory=list)
    palettes: tuple[str, ...] = ("",)  # of each output; "" keeps the input's
    shown: Callable | None = None  # display range of an output, by its number and values


IN = Argument("InputFile", str, "The input grid, with its extension")
DEM = Argument("InputDEM", str, "The input height model, with its extension")
OUT = Argument("OutputFile", str, "The output grid, with its extension")
SIZE = Argument("NeighbourhoodSize", int, "Radius of the box in cells", 1)
BINS = Argument("NumBins", int, "How many classes", 1)
LOG = Argument("LogTransform", bool, "Whether the natural logarithm is written", False)


def _symmetric(k: int, df: DataFrame) -> tuple[float, float]:
    """The lesser of the two ends, on either side of 0."""
    lo, hi = df.agg(F.min("z"), F.max("z")).first()
    most = min(abs(lo or 0.0), hi or 0.0)
    return -most, most


def _trimmed(k: int, df: DataFrame) -> tuple[float, float]:
    r = local.trimmed(local.histogram(df)).first()
    return (r["display_min"], r["display_max"]) if r else (0.0, 255.0)


def _geometry(spark: SparkSession, h: dict, compat: bool = False) -> tuple[float, float, float]:
    """Cell width and height, and the factor for heights; a header's ``geographic`` overrides what its projection says."""
    row = [(float(h["rows"]), float(h["cols"]), h["north"], h["south"], h["east"], h["west"], h["pixel_is_area"], h["epsg"], h["crs_wkt"], h["xy_units"])]
    spec = "rows double, cols double, north double, south double, east double, west double, pixel_is_area boolean, epsg int, crs_wkt string, xy_units string"
    m = spark.createDataFrame(row, spec)
    return tuple(m.select(model.cell_size_x(), model.cell_size_y(), model.z_conversion(compat, h.get("geographic"))).first())


def _focal(fn: Callable) -> Callable:
    return lambda spark, df, h, *args: fn(df, *args)


def _gradient(fn: Callable) -> Callable:
    def run(spark, df, h):
        x, y, factor = _geometry(spark, h, h.get("compat", False))
        return fn(df, (x + y) / 2, factor)

    return run


def _d8(spark, df, h, log=False):
    x, y, _ = _geometry(spark, h)
    return flow.d8_accumulation(df, x, y, log, h.get("compat", False))


def _breach(spark, df, h, depth=-1.0, length=-1, constrained=False, fill=False):
    limits = (float("inf") if depth < 0 else depth, 1 << 31 if length < 0 else length)
    mode = "complete" if depth < 0 and length < 0 else "constrained" if constrained else "selective"
    return hydro.breach_depressions(df, mode, *limits, fill)


def _med(spark, df, h, least=1, most=3, step=1):
    m = focal.max_elevation_deviation(df, least, most, step)
    return [m.withColumnRenamed(c, "z").select("raster_id", "row", "col", "z") for c in ("magnitude", "scale")]


def _streams(spark, df, h, streams):
    other, h2 = datasource.read_raster(spark, streams)
    if (h["rows"], h["cols"]) != (h2["rows"], h2["cols"]):
        raise ValueError("the grids have different dimensions")
    return hydro.breach_streams(df, other.withColumn("raster_id", F.lit(os.path.basename(h["_path"]))))


def las_info(spark: SparkSession, path: str) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("las_header").load(path)


def las_points(spark: SparkSession, path: str, class_bits: int = 4) -> DataFrame:
    datasource.register(spark)
    df = spark.read.format("las").load(path)
    df = df.withColumns(points.return_fields(F.col("flags")) | points.class_fields(F.col("class_byte"), class_bits))
    return df.select(*[f.split()[0] for f in model.POINT_FIELDS.split(", ")])


def geotiff_tags(spark: SparkSession, path: str) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("geotiff_tags").load(path).orderBy("section", "code")


TOOLS = [
    Tool("Slope", "Slope in degrees", [IN, OUT], _gradient(local.slope), palettes=("spectrum.pal",)),
    Tool("Aspect", "Downslope direction in degrees", [IN, OUT], _gradient(local.aspect), palettes=("circular_bw.pal",)),
    Tool("Hillshade", "Shaded relief", [IN, OUT], _gradient(local.hillshade), palettes=("grey.pal",), shown=_trimmed),
    Tool("MeanFilter", "Mean of a box around each cell", [IN, OUT, Argument("FilterSizeX", int, "Columns of the box", 3), Argument("FilterSizeY", int, "Rows of the box")], _focal(focal.mean_filter)),
    Tool("DeviationFromMean", "Standard score in a box", [DEM, OUT, SIZE], _focal(focal.deviation_from_mean), palettes=("blue_white_red.plt",), shown=lambda k, df: (-2.58, 2.58)),
    Tool("DeviationFromMeanTraditional", "Standard score in a symmetric box", [DEM, OUT, SIZE], _focal(focal.deviation_from_mean_traditional), palettes=("blue_white_red.plt",), shown=lambda k, df: (-2.58, 2.58)),
    Tool("DifferenceFromMean", "Difference from the mean of a box", [DEM, OUT, SIZE], _focal(focal.difference_from_mean), palettes=("blue_white_red.plt",), shown=_symmetric),
    Tool("MaxElevationDeviation", "Largest standard score over scales",
         [DEM, Argument("OutputMagnitudeFile", str, "The output of scores"), Argument("OutputScaleFile", str, "The output of radii"), Argument("MinNeighbourhoodSize", int, "Least radius", 1),
          Argument("MaxNeighbourhoodSize", int, "Greatest radius", 3), Argument("NeighbourhoodStep", int, "Step of the radius", 1)], _med, outputs=2, palettes=("blue_white_red.plt", "imhof1.plt"), shown=lambda k, df: None if k else (-3.0, 3.0)),
    Tool("ElevationPercentile", "Percentile in a box", [DEM, OUT, SIZE, BINS], _focal(focal.elevation_percentile), palettes=("blue_white_red.plt",), shown=lambda k, df: (0.0, 100.0)),
    Tool("Quantiles", "Classes of equal counts", [IN, OUT, BINS], _focal(stats.quantiles)),
    Tool("FillSmallNodataHoles", "Fills no-data between valid cells", [DEM, OUT], _focal(focal.fill_small_nodata_holes)),
    Tool("D8FlowAccumulation", "Accumulation along steepest descents", [DEM, OUT, LOG], _d8, palettes=("blueyellow.pal",)),
    Tool("FD8FlowAccum", "Accumulation over all descents", [DEM, OUT, LOG, Argument("PerformParallel", bool, "Kept for scripts; every run is parallel", True)], lambda s, df, h, log=False, _=True: flow.fd8_accumulation(df, log), palettes=("blueyellow.pal",)),
    Tool("FillDepressions", "Raises cells from which water can't get out", [DEM, OUT, Argument("FixFlats", bool, "Whether flats get a small fall", False)], _focal(hydro.fill_depressions)),
    Tool("BreachDepressions", "Carves trenches out of pits",
         [DEM, OUT, Argument("MaxDepth", float, "Greatest depth of a trench, -1 for any", -1.0), Argument("MaxLength", int, "Most cells of a trench, -1 for any", -1),
          Argument("ConstrainedBreaching", bool, "Whether trenches may end early", False), Argument("SubsequentFilling", bool, "Whether filling follows", False)], _breach),
    Tool("BreachStreams", "Carves trenches along a stream network", [DEM, OUT, Argument("StreamsFile", str, "Grid with streams over 0")], _streams),
    Tool("Whitebox2GeoTiff", "Converts a grid to GeoTIFF, or any format to any", [IN, OUT], lambda spark, df, h: df, aliases=["Convert"]),
]
KEEPS_RANGE = ("FillDepressions", "BreachDepressions", "BreachStreams", "FillSmallNodataHoles", "Whitebox2GeoTiff")  # outputs are heights as the input's
PRINTERS = {"PrintGeoTiffTags": geotiff_tags, "PrintLASInfo": las_info}


def list_tools() -> list[tuple[str, str]]:
    found = [(t.name, t.text) for t in TOOLS] + [("PrintGeoTiffTags", "Shows the tags of a GeoTIFF"), ("PrintLASInfo", "Shows the header of a LAS file")]
    return sorted((n, d[:DESCRIPTION_LENGTH]) for n, d in found)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.text, len(t.arguments)) for t in TOOLS] + [(p, "Shows a file's header", 1) for p in PRINTERS]
    return spark.createDataFrame(rows, "tool string, description string, n_arguments int")


def raster_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, list(e)) for f, e in EXTENSIONS.items()], "format string, extensions array<string>")


def find(name: str) -> Tool:
    """By full name, or the name cut to twenty characters; case doesn't matter."""
    short = name.lower()[:NAME_LENGTH]
    for t in TOOLS:
        if short in {n.lower()[:NAME_LENGTH] for n in (t.name, *t.aliases)}:
            # full names win where cut ones are alike
            return next((x for x in TOOLS if x.name.lower() == name.lower()), t)
    raise KeyError(f"no tool is named {name!r}")


def help_text(name: str) -> str:
    if name in PRINTERS:
        return f"{name}: InputFile"
    t = find(name)
    return "\n".join([f"{t.name}: {t.text}", *[f"  {a.name} ({a.kind.__name__}{'' if a.default is None else f', default {a.default}'}): {a.text}" for a in t.arguments]])


def split_arguments(text: str) -> list[str]:
    return [a.strip() for a in text.replace(",", ";").split(";")] if text else []


def _value(a: Argument, text):
    if not isinstance(text, str):
        return text
    if a.kind is bool:
        return text.strip().lower() in ("1", "true", "t", "yes", "y")
    return a.kind(text)


_FOLDER = ["."]


def set_working_folder(path: str) -> str:
    """Where names without a separator are looked for from now on; it must exist."""
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    _FOLDER[0] = path
    return path


def working_folder() -> str:
    return _FOLDER[0]


def version() -> str:
    return __version__


def resolve(name: str, folder: str) -> str:
    """Names without a separator are in the working folder; outputs of unknown kind become GeoTIFF."""
    return name if os.sep in name else os.path.join(folder, name)


def run(
    spark: SparkSession, name: str, arguments: list, folder: str | None = None, listener: Callable[[str], None] = print, compat: bool = False, geographic: bool | None = None
):
    """Run a tool on files; printers return a table, the others the seconds they took.

    ``compat`` reproduces old quirks where a tool has them; ``geographic`` says
    whether coordinates are degrees, where the header doesn't tell.
    """
    folder = working_folder() if folder is None else folder
    for p, show in PRINTERS.items():
        if p.lower()[:NAME_LENGTH] == name.lower()[:NAME_LENGTH]:
            return show(spark, resolve(arguments[0], folder))
    tool, began = find(name), time.time()
    files = 1 + tool.outputs
    if len(arguments) < files or len(arguments) > len(tool.arguments):
        raise ValueError(help_text(tool.name))
    source, *targets = [resolve(a, folder) for a in arguments[:files]]
    targets = [t if is_supported(t) else t + ".tif" for t in targets]
    rest = [_value(a, v) for a, v in zip(tool.arguments[files:], arguments[files:], strict=False)]
    rest = [resolve(v, folder) if a.kind is str else v for a, v in zip(tool.arguments[files:], rest, strict=False)]
    df, h = datasource.read_raster(spark, source)
    h |= {"_path": source, "compat": compat, "geographic": geographic}
    got = tool.run(spark, df, h, *rest)
    kind = {"Quantiles": "INT16"}.get(tool.name, h["data_type"] if tool.name == "Whitebox2GeoTiff" else "FLOAT32")
    outs = got if isinstance(got, list) else [got]
    for k, (out, target) in enumerate(zip(outs, targets, strict=True)):
        codec(target)
        shown = tool.shown and tool.shown(k, out)
        lo, hi = shown or ((h["display_min"], h["display_max"]) if tool.name in KEEPS_RANGE else (None, None))
        settings = {"data_type": kind, "palette": tool.palettes[k] or h["palette"], "display_min": lo, "display_max": hi, "nodata": h["nodata"] if abs(h["nodata"]) < 1e30 else -32768.0}
        notes = [f"Created by {tool.name}", *[f"{a.name}: {v}" for a, v in zip(tool.arguments[files:], rest, strict=False)]]
        datasource.write_raster(out, target, h | settings | {"metadata": notes})
    took = time.time() - began
    listener(f"{tool.name}: {took:.2f} s")
    return took
