"""Named queries that go through files: the grid is written by the distributed writer and read back in blocks.

Files are in the shared folder, which must be mounted where the session runs, and go when the driver ends.
"""

from __future__ import annotations

import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..session import new_path
from ..sources import codes, datasource, las
from ..sources.errors import DataError
from ..sources.formats import EMPTY, EXTENSIONS, detect

RES = 1000.0
FORMATS = ("arcgis_ascii", "arcgis_binary", "grass_ascii", "whitebox", "idrisi", "geotiff")


def folder(spark: SparkSession, tag: str) -> str:
    path = new_path(spark, tag)
    if "://" in path.removeprefix("file://"):
        raise RuntimeError("grid files need a shared folder that is mounted, not an object store")
    os.makedirs(at := path.removeprefix("file://"), exist_ok=True)
    return at


def written(spark: SparkSession, df: DataFrame, name: str, **more) -> str:
    """The path of ``df`` as a file of a format."""
    rows = df.agg(F.max("row")).first()[0]
    rows = 0 if rows is None else rows + 1
    h = EMPTY | {"rows": rows, "cols": 64, "west": 0.0, "south": 0.0, "east": 64 * RES, "north": rows * RES, "crs_wkt": "PROJCS[grid]"} | more
    path = os.path.join(folder(spark, name), "dem" + EXTENSIONS[name][0])
    datasource.write_raster(df, path, h, name)
    return path


def back(spark: SparkSession, path: str) -> DataFrame:
    datasource.register(spark)
    return spark.read.format("raster").option("blockCells", 64 * 100).load(path)


def raster_meta(spark: SparkSession, df: DataFrame) -> DataFrame:
    paths = [written(spark, df, name) for name in FORMATS]
    datasource.register(spark)
    got = [spark.read.format("raster_meta").load(p) for p in paths]
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    whole = [F.col(c).cast("long").alias(c) for c in ("rows", "cols")]
    return out.select("format", *whole, "north", "south", "east", "west", "nodata", "data_type", "byte_order")


def geotiff_tags(spark: SparkSession, df: DataFrame) -> DataFrame:
    t = registry.geotiff_tags(spark, written(spark, df, "geotiff", epsg=32617))
    return t.filter("code not in (273, 279)").select("section", F.col("code").cast("long").alias("code"), "name", "dtype", F.col("count").cast("long").alias("count"), "value", "keyword")


def converted(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Whitebox to GeoTIFF by the tool of that name."""
    source = written(spark, df, "whitebox")
    at = os.path.dirname(source)
    registry.run(spark, "Whitebox2GeoTiff", [os.path.basename(source), "out.tif"], at, lambda s: None)
    return back(spark, os.path.join(at, "out.tif"))


def las_files(spark: SparkSession, events: DataFrame) -> str:
    """A LAS file for each partition of ``events`` that has rows, written by the executors: x is the id, y the seconds of the day, z the value in hundredths.

    Raw x counts from the partition's first id, for ids can be beyond 32 bits.
    """
    at = folder(spark, "las")

    def raw(b: pa.RecordBatch, base: int) -> np.ndarray:
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in b.schema.names}
        x = c["id"] - base
        if len(x) and (x.min() < -(1 << 31) or x.max() >= 1 << 31):
            raise DataError(f"ids of one partition are too far apart for a LAS file: {c['id'].min()} and {base}")
        r = np.zeros(len(x), las.CORE)
        r["x"], r["y"], r["z"], r["intensity"], r["flags"], r["class"] = x, c["sec"], c["cents"], c["id"] % 65536, c["id"] % 256, c["id"] // 256 % 256
        r["angle"], r["user"], r["source"] = c["id"] % 181 - 90, c["id"] % 200, c["id"] % 1000
        return r

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:  # a partition can be empty: a part of a file in which no row group begins
            return
        base = first.column("id")[0].as_py()
        own = os.path.join(at, f".{uuid.uuid4().hex}")
        n = las.write_parts(own, (raw(b, base) for b in itertools.chain([first], batches)), (1.0, 1.0, 0.01), (float(base), 100.0, 0.0), day=60, year=2016)
        os.replace(own, os.path.join(at, f"part-{TaskContext.get().partitionId()}.las"))  # a repeated attempt has the same rows
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    e = events.select(F.col("event_id").alias("id"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("sec"), F.round(F.col("value") * 100).cast("int").alias("cents"))
    e.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return at


def las_scan(spark: SparkSession, events: DataFrame) -> DataFrame:
    p = registry.las_points(spark, las_files(spark, events))
    ints = ["intensity", "return_number", "number_of_returns", "class_value", "scan_angle", "user_data", "point_source_id"]
    flags = ["scan_direction", "edge_of_flightline", "class_name", "synthetic", "key_point", "withheld"]
    return p.select(F.col("x").cast("long").alias("event_id"), "y", F.round("z", 2).alias("z"), *[F.col(c).cast("long").alias(c) for c in ints], *flags)


def las_scan_five_bits(spark: SparkSession, events: DataFrame) -> DataFrame:
    p = registry.las_points(spark, las_files(spark, events), class_bits=5)
    return p.select(F.col("x").cast("long").alias("event_id"), F.col("class_value").cast("long").alias("class_value"), "class_name", "synthetic", "key_point", "withheld")


def las_info(spark: SparkSession, events: DataFrame) -> DataFrame:
    h = registry.las_info(spark, las_files(spark, events))
    return h.groupBy("version", F.col("created").cast("string").alias("created"), F.col("point_format").cast("long").alias("point_format")).agg(
        F.sum("n_points").cast("long").alias("n_points"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
        F.round(F.min("min_z"), 2).alias("min_z"), F.round(F.max("max_z"), 2).alias("max_z"), F.sum(F.aggregate("points_by_return", F.lit(0).cast("long"), lambda a, x: a + x)).alias("returned"),
    )


def detected(spark: SparkSession) -> DataFrame:
    names = [f"grid{e.upper() if k % 2 else e}" for k, e in enumerate(sorted({e for x in EXTENSIONS.values() for e in x} - {".txt"}))]
    return spark.createDataFrame([(n, detect(n)) for n in names], "file string, format string")


def code_names(spark: SparkSession) -> DataFrame:
    """UTM systems and their datums' ellipsoids: what follows from rules."""
    t = codes.code_table(spark)
    return t.filter("tag = 3072 and name like 'PCS_WGS84%' or tag = 3074 or tag = 2048 and code in (4267, 4269, 4326) or tag = 2050 and code = 6326").select(
        F.col("tag").cast("long").alias("tag"), F.col("code").cast("long").alias("code"), "name"
    )
