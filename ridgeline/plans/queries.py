"""Named queries over the test tables, and the same in DuckDB's SQL.

The vectors of ``embeddings`` serve as a height model: a row for each vector, a
column for each component, heights in whole units, cells of 1000 by 1000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions, model, registry
from ..operators import flow, focal, grid, hydro, local, points, stats
from . import files

RES = 1000.0


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.from_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no-data in a scattered pattern."""
    return dem(spark, sf_dir).withColumn("z", F.when((F.col("row") * 31 + F.col("col") * 17) % 23 != 0, F.col("z")))


def shown(df: DataFrame, *names: str) -> DataFrame:
    names = names or ("z",)
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _las_bitfields(spark, d):
    e = events(spark, d).select("event_id", (F.col("event_id") % 256).cast("int").alias("b"))
    return e.select("event_id", *[c.alias(k) for k, c in (points.return_fields(F.col("b")) | points.class_fields(F.col("b"))).items()])


def _las_scale_offset(spark, d):
    e = events(spark, d)
    return e.select("event_id", F.round(points.scaled(F.col("user_id"), 0.01, 100.0), 6).alias("x"), F.round(points.scaled(F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"), 0.01, 200.0), 6).alias("y"))


def _kd_radius_search(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").cast("double").alias("x"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("y"))
    got = points.within_radius(e, e.filter("event_id % 100 = 0"), 60.0)
    return got.groupBy("q_event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_ids"))


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) for n in ("row", "col", *names)])


def _d8_inflow(spark, d):
    return _ints(flow.inflow_count(flow.d8_pointers(dem(spark, d), RES, RES)), "n")


def _streams(spark, d):
    z = dem(spark, d)
    return hydro.breach_streams(z, z.withColumn("z", (F.col("col") == 32).cast("double")))


def _shade(s, d):
    return local.hillshade(dem(s, d), RES)


def _plain(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])


def _round_trip(name: str):
    return lambda s, d: shown(files.back(s, files.written(s, holes(s, d), name)))


def _breach_check(s, d):
    """What holds after complete breaching, whatever way the trenches took."""
    out = hydro.breach_depressions(holes(s, d))
    return out.agg(F.count(F.lit(1)).alias("n_cells"), F.count("z").alias("n_valid")).crossJoin(hydro.pit_cells(out).agg(F.count(F.lit(1)).alias("n_pits")))  # single rows


def _quantisation(s, d):
    e = grid.extremes(holes(s, d))
    return e.select(functions.quantisation(F.col("min_z"), F.col("max_z")).alias("multiplier"))


def _angles(s, d):
    v = F.col("value")
    e = events(s, d).select("event_id", functions.radians_to_grads(v).alias("g"), functions.grads_to_radians(v).alias("r"), functions.day_of_year((F.col("event_id") % 366 + 1).cast("int"), (2013 + F.col("event_id") % 8).cast("int")).cast("string").alias("day"))
    return e.select("event_id", F.round("g", 6).alias("grads"), F.round("r", 6).alias("radians"), "day")


def _colours(s, d):
    id_ = F.col("event_id").cast("long")
    packed = functions.packed_colour(*[(id_ * k % 256) for k in (1, 3, 5, 7)])
    e = events(s, d).select("event_id", packed.alias("packed"), functions.colour_parts(packed).alias("p"))
    return e.select("event_id", "packed", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("alpha", "red", "green", "blue")])


def _geometry(s, d):
    """Cell sizes, and the factor for heights, of grids made up from suppliers."""
    k = F.col("s_suppkey")
    m = s.read.parquet(f"{d}/supplier.parquet").select(
        "s_suppkey", (k % 50 + 10).cast("double").alias("rows"), (k % 40 + 20).cast("double").alias("cols"), (k % 80 + 2.5).alias("north"), (k % 80 - 1.5).alias("south"),
        (k % 100 + 9.0).alias("east"), (k % 100 + 1.0).alias("west"), (k % 2 == 0).alias("pixel_is_area"), F.when(k % 3 == 0, 4326).otherwise(32617).alias("epsg"),
        F.when(k % 5 == 0, "GEOGCS[x]").otherwise("PROJCS[x]").alias("crs_wkt"), F.when(k % 7 == 0, "Degrees").otherwise("metres").alias("xy_units"),
    )
    six = lambda c, name: F.round(c, 9).alias(name)
    return m.select(
        "s_suppkey", six(model.cell_size_x(), "size_x"), six(model.cell_size_y(), "size_y"), six(model.grid_resolution(), "resolution"),
        six(model.z_conversion(), "factor"), six(model.z_conversion(compat=True), "factor_compat"),
    )


def queries() -> dict:
    return {
        **{f"{k}_roundtrip": _round_trip(k) for k in files.FORMATS},
        "raster_meta": lambda s, d: files.raster_meta(s, holes(s, d)),
        "geotiff_tags": lambda s, d: files.geotiff_tags(s, holes(s, d)),
        "whitebox_to_geotiff": lambda s, d: shown(files.converted(s, holes(s, d))),
        "las_scan": lambda s, d: files.las_scan(s, events(s, d)),
        "las_scan_five_bits": lambda s, d: files.las_scan_five_bits(s, events(s, d)),
        "las_info": lambda s, d: files.las_info(s, events(s, d)),
        "tool_catalog": lambda s, d: registry.catalog(s).select("tool", F.col("n_arguments").cast("long").alias("n_arguments")),
        "raster_formats": lambda s, d: registry.raster_formats(s).select("format", F.array_join("extensions", " ").alias("extensions")),
        "format_detection": lambda s, d: files.detected(s),
        "code_names": lambda s, d: files.code_names(s),
        "new_grid": lambda s, d: shown(grid.new_grid(s, 70, 40, 7.5)),
        "quantisation": _quantisation,
        "angles_and_days": _angles,
        "packed_colours": _colours,
        "cell_geometry": _geometry,
        "natural_log": lambda s, d: shown(local.natural_log(holes(s, d).withColumn("z", F.abs("z") + 1))),
        "fd8_inflow_count": lambda s, d: _ints(flow.fd8_inflow_count(holes(s, d)), "n"),
        "fd8_flow_accum_ln": lambda s, d: shown(flow.fd8_accumulation(holes(s, d), log=True)),
        "d8_flow_accum_holes": lambda s, d: shown(flow.d8_accumulation(holes(s, d), RES, RES)),
        "fill_depressions_sloped": lambda s, d: shown(hydro.fill_depressions(holes(s, d), True)),
        "breach_check": _breach_check,
        "dem_stats": lambda s, d: grid.extremes(holes(s, d)).drop("raster_id"),
        "slope": lambda s, d: shown(local.slope(holes(s, d), RES)),
        "aspect": lambda s, d: shown(local.aspect(holes(s, d), RES)),
        "hillshade": lambda s, d: shown(_shade(s, d)),
        "hillshade_holes": lambda s, d: shown(local.hillshade(holes(s, d), RES)),
        "hillshade_histogram": lambda s, d: local.histogram(_shade(s, d)).select("z", "n"),
        "hillshade_trim": lambda s, d: _plain(local.trimmed(local.histogram(_shade(s, d))), "display_min", "display_max"),
        "mean_filter_3x3": lambda s, d: shown(focal.mean_filter(holes(s, d), 3)),
        "mean_filter_7x3": lambda s, d: shown(focal.mean_filter(holes(s, d), 7, 3)),
        "deviation_from_mean": lambda s, d: shown(focal.deviation_from_mean(holes(s, d), 3)),
        "deviation_from_mean_traditional": lambda s, d: shown(focal.deviation_from_mean_traditional(holes(s, d), 3)),
        "difference_from_mean": lambda s, d: shown(focal.difference_from_mean(holes(s, d), 3)),
        "max_elevation_deviation": lambda s, d: shown(focal.max_elevation_deviation(holes(s, d), 1, 5, 2), "magnitude", "scale"),
        "elevation_percentile": lambda s, d: shown(focal.elevation_percentile(holes(s, d), 3, 5)),
        "quantiles": lambda s, d: shown(stats.quantiles(holes(s, d), 5)),
        "fill_small_nodata_holes": lambda s, d: shown(focal.fill_small_nodata_holes(holes(s, d))),
        "d8_pointer": lambda s, d: _ints(flow.d8_pointers(holes(s, d), RES, RES), "direction"),
        "d8_inflow_count": _d8_inflow,
        "d8_flow_accum": lambda s, d: shown(flow.d8_accumulation(dem(s, d), RES, RES)),
        "d8_flow_accum_ln": lambda s, d: shown(flow.d8_accumulation(dem(s, d), RES, RES, log=True)),
        "fd8_weights": lambda s, d: _fd8_weights(s, d),
        "fd8_flow_accum": lambda s, d: shown(flow.fd8_accumulation(dem(s, d))),
        "edge_cells": lambda s, d: shown(hydro.edge_cells(holes(s, d))),
        "pit_cells": lambda s, d: shown(hydro.pit_cells(holes(s, d))),
        "fill_depressions": lambda s, d: shown(hydro.fill_depressions(holes(s, d))),
        "breach_depressions": lambda s, d: shown(hydro.breach_depressions(dem(s, d))),
        "breach_streams": lambda s, d: shown(_streams(s, d)),
        "integral_image": lambda s, d: shown(grid.prefix_sums(holes(s, d), F.coalesce("z", F.lit(0.0))), "s"),
        "las_bitfields": _las_bitfields,
        "las_scale_offset": _las_scale_offset,
        "kd_radius_search": _kd_radius_search,
    }


def _fd8_weights(s, d):
    e = flow.fd8_edges(holes(s, d))
    return e.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "to_row", "to_col")], F.round("w", 6).alias("w"))


# ---- the same in SQL ----

_DEM = """dem AS (
  SELECT vec_id AS row, i - 1 AS col, round(CAST(embedding[i] AS DOUBLE) * 10000) + 0.0 AS z
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
)"""
_HOLES = _DEM.replace("dem AS", "dem0 AS") + ", dem AS (SELECT row, col, CASE WHEN (row * 31 + col * 17) % 23 <> 0 THEN z END AS z FROM dem0)"
_NEAR = """nb AS (
  SELECT c.row, c.col, c.z, ne.z AS ne, e.z AS e, se.z AS se, s.z AS s, sw.z AS sw, w.z AS w, nw.z AS nw, n.z AS n
  FROM dem c
  LEFT JOIN dem ne ON ne.row = c.row - 1 AND ne.col = c.col + 1 LEFT JOIN dem e ON e.row = c.row AND e.col = c.col + 1
  LEFT JOIN dem se ON se.row = c.row + 1 AND se.col = c.col + 1 LEFT JOIN dem s ON s.row = c.row + 1 AND s.col = c.col
  LEFT JOIN dem sw ON sw.row = c.row + 1 AND sw.col = c.col - 1 LEFT JOIN dem w ON w.row = c.row AND w.col = c.col - 1
  LEFT JOIN dem nw ON nw.row = c.row - 1 AND nw.col = c.col - 1 LEFT JOIN dem n ON n.row = c.row - 1 AND n.col = c.col
)"""
_GRAD = """f AS (
  SELECT row, col, z, coalesce(ne, z) AS ne, coalesce(e, z) AS e, coalesce(se, z) AS se, coalesce(s, z) AS s, coalesce(sw, z) AS sw,
         coalesce(w, z) AS w, coalesce(nw, z) AS nw, coalesce(n, z) AS n FROM nb
), g AS (
  SELECT row, col, z, (nw - sw + 2 * (n - s) + ne - se) / 8000.0 AS fy, (se - sw + 2 * (e - w) + ne - nw) / 8000.0 AS fx FROM f
)"""
_ASPECT = "(180 - degrees(atan(fy / fx)) + 90 * sign(fx))"
_SHADE = f"""shade AS (
  SELECT row, col, CASE WHEN z IS NULL THEN NULL ELSE greatest(0.0, floor(round(255 * CASE WHEN fx = 0 THEN 0.5 ELSE
    sqrt(fx * fx + fy * fy) / sqrt(1 + fx * fx + fy * fy) * (sin(radians(30.0)) / sqrt(fx * fx + fy * fy)
    - cos(radians(30.0)) * sin(radians(225.0) - radians({_ASPECT}))) END, 9))) END AS z FROM g
)"""


def _box(rx: int, ry: int, counted: str, value: str) -> str:
    w = f"OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {rx} PRECEDING AND {rx} FOLLOWING)"
    h = f"OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {ry} PRECEDING AND {ry} FOLLOWING)"
    on = f"CASE WHEN z IS NOT NULL AND {counted} THEN"
    return f"""k AS (SELECT min(z) AS lo, min(z) + (max(z) - min(z)) / 2 AS mid FROM dem),
v AS (SELECT row, col, {value} AS z FROM dem, k),
h1 AS (SELECT row, col, z, sum({on} z ELSE 0 END) {w} AS s, sum({on} z * z ELSE 0 END) {w} AS q, sum({on} 1 ELSE 0 END) {w} AS n FROM v),
b AS (SELECT row, col, z, sum(s) {h} AS s, sum(q) {h} AS q, CAST(sum(n) {h} AS DOUBLE) AS n FROM h1)"""


_INNER = "row > 0 AND col > 0"


def _deviation(radius: int, counted: str = _INNER, least: int = 0) -> str:
    return f"""WITH {_HOLES}, {_box(radius, radius, counted, 'z - mid')}
SELECT row, col, CASE WHEN z IS NULL THEN NULL WHEN n > {least} AND (q - s * s / n) / n > 0
  THEN round((z - s / n) / sqrt((q - s * s / n) / n), 6) ELSE 0.0 END AS z FROM b"""


def _scales() -> str:
    parts = [f"d{r} AS (WITH {_box(r, r, _INNER, 'z - mid')} SELECT row, col, {r} AS r, CASE WHEN z IS NOT NULL AND n > 0 AND (q - s * s / n) / n > 0 THEN (z - s / n) / sqrt((q - s * s / n) / n) END AS d FROM b)" for r in (1, 3, 5)]
    return f"""WITH {_HOLES}, {', '.join(parts)}, u AS (SELECT * FROM d1 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d5),
o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY abs(d) DESC NULLS LAST, r) AS k FROM u)
SELECT row, col, round(d, 6) AS magnitude, CASE WHEN d IS NOT NULL THEN CAST(r AS DOUBLE) END AS scale FROM o WHERE k = 1"""


_FINE = """k AS (SELECT min(z) AS lo, ceil(max(z) - min(z)) / 10000 AS size FROM dem),
t AS (SELECT row, col, z, CASE WHEN z IS NOT NULL THEN CAST(least(floor((z - lo) / size), 9999) AS INTEGER) END AS fine FROM dem, k),
hist AS (SELECT fine, count(*) AS n FROM t WHERE fine IS NOT NULL GROUP BY fine)"""

_PERCENTILE = f"""WITH RECURSIVE {_HOLES}, {_FINE},
every AS (SELECT i AS fine, coalesce(n, 0) AS n FROM range(10000) r(i) LEFT JOIN hist ON fine = i),
quota AS (SELECT CAST(floor(sum(n) / 5.0) AS BIGINT) AS q FROM hist),
walk(fine, bin, running) AS (
  SELECT -1, 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT e.fine, CASE WHEN w.running + e.n > q AND w.bin < 4 THEN w.bin + 1 ELSE w.bin END,
         CASE WHEN w.running + e.n > q AND w.bin < 4 THEN CAST(e.n AS BIGINT) ELSE CAST(w.running + e.n AS BIGINT) END
  FROM walk w JOIN every e ON e.fine = w.fine + 1, quota
),
held AS (SELECT bin, sum(n) AS total FROM walk JOIN every USING (fine) GROUP BY bin),
m AS (SELECT w.fine, w.bin, w.running / held.total AS prob FROM walk w JOIN held USING (bin) JOIN hist USING (fine)),
x AS (SELECT t.row, t.col, t.z, m.bin, m.prob FROM t LEFT JOIN m USING (fine)),
{{boxes}}
SELECT row, col, CASE WHEN z IS NOT NULL AND total > 0 THEN round(100.0 * (less + prob * own) / total, 6) END AS z FROM c"""


def _percentile() -> str:
    w = "OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    h = "OVER (PARTITION BY col ORDER BY row RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    one = ", ".join(f"sum(CASE WHEN {_INNER} AND bin = {k} THEN 1 ELSE 0 END) {w} AS b{k}" for k in range(5))
    two = ", ".join(f"sum(b{k}) {h} AS b{k}" for k in range(5))
    total = " + ".join(f"b{k}" for k in range(5))
    less = " + ".join(f"CASE WHEN bin > {k} THEN b{k} ELSE 0 END" for k in range(5))
    own = " + ".join(f"CASE WHEN bin = {k} THEN b{k} ELSE 0 END" for k in range(5))
    boxes = f"""y1 AS (SELECT row, col, z, bin, prob, {one} FROM x), y2 AS (SELECT row, col, z, bin, prob, {two} FROM y1),
c AS (SELECT row, col, z, prob, CAST({total} AS DOUBLE) AS total, {less} AS less, {own} AS own FROM y2)"""
    return _PERCENTILE.format(boxes=boxes)


_FALLS = " UNION ALL ".join(
    f"SELECT row, col, {k} AS k, (z - {n}) / {length} AS fall, {dy} AS dy, {dx} AS dx, z - {n} AS drop FROM nb WHERE z > {n}"
    for k, (n, dx, dy, length) in enumerate((
        ("ne", 1, -1, "sqrt(2000000.0)"), ("e", 1, 0, "1000.0"), ("se", 1, 1, "sqrt(2000000.0)"), ("s", 0, 1, "1000.0"),
        ("sw", -1, 1, "sqrt(2000000.0)"), ("w", -1, 0, "1000.0"), ("nw", -1, -1, "sqrt(2000000.0)"), ("n", 0, -1, "1000.0"),
    ))
)
_POINT = f"falls AS ({_FALLS}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, k) AS r FROM falls) WHERE r = 1)"
def _d8_over(grid_sql: str, value: str) -> str:
    return f"""WITH RECURSIVE {grid_sql}, {_NEAR}, {_POINT},
p AS (SELECT row * 64 + col AS c, (row + dy) * 64 + col + dx AS t FROM best),
walk(c) AS (SELECT row * 64 + col FROM dem WHERE z IS NOT NULL UNION ALL SELECT p.t FROM walk JOIN p ON walk.c = p.c),
a AS (SELECT c, count(*) AS n FROM walk GROUP BY c)
SELECT dem.row, dem.col, {value} AS z FROM dem LEFT JOIN a ON a.c = dem.row * 64 + dem.col"""


def _fd8_over(grid_sql: str, value: str) -> str:
    return f"""WITH RECURSIVE {grid_sql}, {_NEAR}, falls AS ({_FALLS}),
e AS (SELECT row * 64 + col AS c, (row + dy) * 64 + col + dx AS t, drop * drop / sum(drop * drop) OVER (PARTITION BY row, col) AS w FROM falls),
x(c, v) AS (SELECT row * 64 + col, CAST(1 AS DOUBLE) FROM dem WHERE z IS NOT NULL UNION ALL SELECT e.t, sum(x.v * e.w) FROM x JOIN e ON x.c = e.c GROUP BY e.t),
y AS (SELECT c, {value} AS z FROM x GROUP BY c)
SELECT dem.row, dem.col, y.z FROM dem LEFT JOIN y ON y.c = dem.row * 64 + dem.col"""


def _fill(level: str) -> str:
    """Levels fall until none changes; ``level`` is what a cell of height z gets from a neighbour at v."""
    return f"""WITH RECURSIVE {_HOLES}, {_NEAR},
k AS (SELECT 1 / power(10, 8 - length(CAST(CAST(floor(max(z) - min(z)) AS BIGINT) AS VARCHAR))) AS small FROM dem),
g AS (SELECT row * 64 + col AS c, col, z, (ne IS NULL OR e IS NULL OR se IS NULL OR s IS NULL OR sw IS NULL OR w IS NULL OR nw IS NULL OR n IS NULL) AS edge FROM nb WHERE z IS NOT NULL),
o(d) AS (VALUES (-65), (-64), (-63), (-1), (1), (63), (64), (65)),
l AS (SELECT c, z, c + d AS t, small FROM g, o, k WHERE NOT edge),
f(c, v) USING KEY (c) AS (
  SELECT c, z FROM g WHERE edge
  UNION ALL
  SELECT l.c, min({level}) AS v FROM f JOIN l ON l.t = f.c LEFT JOIN recurring.f AS r ON r.c = l.c WHERE r.v IS NULL OR {level} < r.v GROUP BY l.c
)
SELECT dem.row, dem.col, round(f.v, 6) AS z FROM dem LEFT JOIN f ON f.c = dem.row * 64 + dem.col"""


_TAGS = """(VALUES ('image', 256, 'ImageWidth', 'LONG', 1, '64', NULL), ('image', 258, 'BitsPerSample', 'SHORT', 1, '32', NULL), ('image', 259, 'Compression', 'SHORT', 1, '1', 'None'),
('image', 262, 'PhotometricInterpretation', 'SHORT', 1, '1', 'BlackIsZero'), ('image', 277, 'SamplesPerPixel', 'SHORT', 1, '1', NULL), ('image', 278, 'RowsPerStrip', 'LONG', 1, '1', NULL),
('image', 284, 'PlanarConfiguration', 'SHORT', 1, '1', 'Contiguous'), ('image', 339, 'SampleFormat', 'SHORT', 1, '3', 'Floating point data'),
('image', 33550, 'ModelPixelScaleTag', 'DOUBLE', 3, '1000.0, 1000.0, 0.0', NULL), ('image', 34735, 'GeoKeyDirectoryTag', 'SHORT', 20, '1, 1, 0, 4, 1024, 0, 1, 1, 1025, 0, 1, 1, 1026, 34737, 13, 0 ...', NULL),
('image', 34737, 'GeoAsciiParamsTag', 'ASCII', 14, 'PROJCS[grid]|', NULL), ('image', 42113, 'GDAL_NODATA', 'ASCII', 7, '-32768', NULL),
('geokey', 1024, 'GTModelTypeGeoKey', 'SHORT', 1, '1', 'ModelTypeProjected'), ('geokey', 1025, 'GTRasterTypeGeoKey', 'SHORT', 1, '1', 'RasterPixelIsArea'),
('geokey', 1026, 'GTCitationGeoKey', 'ASCII', 1, 'PROJCS[grid]', NULL), ('geokey', 3072, 'ProjectedCSTypeGeoKey', 'SHORT', 1, '32617', 'PCS_WGS84_UTM_zone_17N'))
t(section, code, name, dtype, count, value, keyword)"""
_CATALOG = """(VALUES ('Slope', 2), ('Aspect', 2), ('Hillshade', 2), ('MeanFilter', 4), ('DeviationFromMean', 3), ('DeviationFromMeanTraditional', 3), ('DifferenceFromMean', 3),
('MaxElevationDeviation', 6), ('ElevationPercentile', 4), ('Quantiles', 3), ('FillSmallNodataHoles', 2), ('D8FlowAccumulation', 3), ('FD8FlowAccum', 4), ('FillDepressions', 3),
('BreachDepressions', 6), ('BreachStreams', 3), ('Whitebox2GeoTiff', 2), ('PrintGeoTiffTags', 1), ('PrintLASInfo', 1)) t(tool, n)"""
_FORMATS = """(VALUES ('arcgis_binary', '.flt .hdr'), ('arcgis_ascii', '.asc .txt'), ('grass_ascii', '.txt'), ('whitebox', '.dep .tas'), ('idrisi', '.rst .rdc'),
('geotiff', '.tif .tiff'), ('surfer', '.grd'), ('saga', '.sdat .sgrd')) t(format, extensions)"""
_LAS_CLASS = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(points.CLASS_NAMES))


def _file_sql() -> dict[str, str]:
    seconds = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)"
    byte = "CAST(event_id // 256 % 256 AS INTEGER)"
    mid = lambda m: f"round(CASE WHEN (epsg = 4326 OR wkt NOT LIKE '%projcs[%' OR units LIKE '%deg%') AND abs({m}) <= 90 THEN 1 / (113200 * cos(radians({m}))) ELSE 1 END, 9)"
    return {
        **{f"{k}_roundtrip": f"WITH {_HOLES} SELECT row, col, z FROM dem" for k in files.FORMATS},
        "whitebox_to_geotiff": f"WITH {_HOLES} SELECT row, col, z FROM dem",
        "raster_meta": f"""SELECT format, n AS rows, CAST(64 AS BIGINT) AS cols, n * 1000.0::DOUBLE AS north, 0.0::DOUBLE AS south, 64000.0::DOUBLE AS east, 0.0::DOUBLE AS west, -32768.0::DOUBLE AS nodata,
'FLOAT32' AS data_type, 'LITTLE_ENDIAN' AS byte_order FROM (SELECT count(*) AS n FROM embeddings), (VALUES {', '.join(f"('{k}')" for k in files.FORMATS)}) t(format)""",
        "geotiff_tags": f"""SELECT section, CAST(code AS BIGINT) AS code, name, dtype, CAST(count AS BIGINT) AS count, value, keyword FROM {_TAGS}
UNION ALL SELECT 'image', 257, 'ImageLength', 'LONG', 1, CAST(count(*) AS VARCHAR), NULL FROM embeddings
UNION ALL SELECT 'image', 33922, 'ModelTiepointTag', 'DOUBLE', 6, '0.0, 0.0, 0.0, 0.0, ' || count(*) * 1000 || '.0, 0.0', NULL FROM embeddings""",
        "las_scan": f"""SELECT event_id, {seconds} + 100 AS y, round(round(value * 100) * 0.01, 2) AS z, event_id % 65536 AS intensity, event_id & 7 AS return_number, (event_id >> 3) & 7 AS number_of_returns,
{byte} & 15 AS class_value, event_id % 181 - 90 AS scan_angle, event_id % 200 AS user_data, event_id % 1000 AS point_source_id, (event_id >> 6) & 1 = 1 AS scan_direction,
(event_id >> 7) & 1 = 1 AS edge_of_flightline, CASE {byte} & 15 {_LAS_CLASS} ELSE 'Undefined class value' END AS class_name, ({byte} >> 4) & 1 = 1 AS synthetic,
({byte} >> 5) & 1 = 1 AS key_point, ({byte} >> 6) & 1 = 1 AS withheld FROM events""",
        "las_scan_five_bits": f"""SELECT event_id, {byte} & 31 AS class_value, CASE {byte} & 31 {_LAS_CLASS} ELSE 'Undefined class value' END AS class_name, ({byte} >> 5) & 1 = 1 AS synthetic,
({byte} >> 6) & 1 = 1 AS key_point, ({byte} >> 7) & 1 = 1 AS withheld FROM events""",
        "las_info": f"""SELECT '1.2' AS version, '2016-02-29' AS created, CAST(0 AS BIGINT) AS point_format, count(*) AS n_points, CAST(min(event_id) AS DOUBLE) AS min_x, CAST(max(event_id) AS DOUBLE) AS max_x,
min({seconds}) + 100 AS min_y, max({seconds}) + 100 AS max_y, round(min(round(value * 100)) * 0.01, 2) AS min_z, round(max(round(value * 100)) * 0.01, 2) AS max_z,
CAST(sum(CASE WHEN event_id & 7 BETWEEN 1 AND 5 THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM events""",
        "tool_catalog": f"SELECT tool, CAST(n AS BIGINT) AS n_arguments FROM {_CATALOG}",
        "raster_formats": f"SELECT format, extensions FROM {_FORMATS}",
        "format_detection": f"""WITH e AS (SELECT format, unnest(string_split(extensions, ' ')) AS e FROM {_FORMATS}), u AS (SELECT format, e, row_number() OVER (ORDER BY e) AS k FROM e WHERE e <> '.txt')
SELECT 'grid' || CASE WHEN k % 2 = 0 THEN upper(e) ELSE e END AS file, format FROM u""",
        "code_names": """SELECT 3072 AS tag, 32600 + 100 * s + z AS code, 'PCS_WGS84_UTM_zone_' || z || ['N', 'S'][s + 1] AS name FROM range(2) a(s), range(1, 61) b(z)
UNION ALL SELECT 3074, 16000 + 100 * s + z, 'Proj_UTM_zone_' || z || ['N', 'S'][s + 1] FROM range(2) a(s), range(1, 61) b(z)
UNION ALL SELECT * FROM (VALUES (2048, 4267, 'GCS_NAD27'), (2048, 4269, 'GCS_NAD83'), (2048, 4326, 'GCS_WGS_84'), (2050, 6326, 'Datum_WGS_84'))""",
        "new_grid": "SELECT i // 40 AS row, i % 40 AS col, 7.5::DOUBLE AS z FROM range(2800) t(i)",
        "quantisation": f"WITH {_HOLES} SELECT power(10, 8 - length(CAST(CAST(floor(max(z) - min(z)) AS BIGINT) AS VARCHAR))) AS multiplier FROM dem",
        "angles_and_days": """SELECT event_id, round(value * 200 / pi(), 6) AS grads, round(value * pi() / 200, 6) AS radians,
CAST(make_date(2013 + event_id % 8, 1, 1) + CAST(event_id % 366 AS INTEGER) AS VARCHAR) AS day FROM events""",
        "packed_colours": """SELECT event_id, ((a << 24) | (r << 16) | (g << 8) | b) AS packed, a AS alpha, r AS red, g AS green, b AS blue
FROM (SELECT event_id, event_id % 256 AS a, event_id * 3 % 256 AS r, event_id * 5 % 256 AS g, event_id * 7 % 256 AS b FROM events)""",
        "cell_geometry": f"""WITH m AS (SELECT s_suppkey, s_suppkey % 50 + 10 AS rows, s_suppkey % 40 + 20 AS cols, s_suppkey % 80 + 2.5::DOUBLE AS north, s_suppkey % 80 - 1.5::DOUBLE AS south, 8.0::DOUBLE AS wide,
s_suppkey % 2 = 0 AS area, CASE WHEN s_suppkey % 3 = 0 THEN 4326 ELSE 32617 END AS epsg, CASE WHEN s_suppkey % 5 = 0 THEN 'geogcs[x]' ELSE 'projcs[x]' END AS wkt, CASE WHEN s_suppkey % 7 = 0 THEN 'degrees' ELSE 'metres' END AS units FROM supplier),
c AS (SELECT *, wide / CASE WHEN area THEN cols ELSE cols - 1 END AS x, (north - south) / CASE WHEN area THEN rows ELSE rows - 1 END AS y FROM m)
SELECT s_suppkey, round(x, 9) AS size_x, round(y, 9) AS size_y, round((x + y) / 2, 9) AS resolution, {mid('(north + south) / 2')} AS factor, {mid('(north - south) / 2')} AS factor_compat FROM c""",
        "natural_log": f"WITH {_HOLES} SELECT row, col, round(ln(abs(z) + 1), 6) AS z FROM dem",
        "fd8_inflow_count": f"WITH {_HOLES}, {_NEAR} SELECT row, col, CASE WHEN z IS NOT NULL THEN {' + '.join(f'CAST(coalesce({n} > z, FALSE) AS BIGINT)' for n in ('ne', 'e', 'se', 's', 'sw', 'w', 'nw', 'n'))} END AS n FROM nb",
        "fd8_flow_accum_ln": _fd8_over(_HOLES, "round(ln(sum(v)), 6)"),
        "d8_flow_accum_holes": _d8_over(_HOLES, "CAST(n AS DOUBLE)"),
        "fill_depressions": _fill("greatest(l.z, f.v)"),
        "fill_depressions_sloped": _fill("CASE WHEN l.z > f.v THEN l.z ELSE f.v + l.small END"),
        "breach_check": f"WITH {_HOLES} SELECT count(*) AS n_cells, count(z) AS n_valid, CAST(0 AS BIGINT) AS n_pits FROM dem",
        "hillshade_holes": f"WITH {_HOLES}, {_NEAR}, {_GRAD}, {_SHADE} SELECT row, col, z FROM shade",
    }


def oracle_sql() -> dict[str, str]:
    near, grad = f"WITH {_HOLES}, {_NEAR}", f"WITH {_HOLES}, {_NEAR}, {_GRAD}"
    shade = f"WITH {_DEM}, {_NEAR}, {_GRAD}, {_SHADE}"
    cum = f"{shade}, h AS (SELECT z, count(*) AS n FROM shade WHERE z IS NOT NULL GROUP BY z), c AS (SELECT z, sum(n) OVER (ORDER BY z) AS a, sum(n) OVER (ORDER BY z DESC) AS b, floor(sum(n) OVER () * 0.01) AS t FROM h)"
    names = ("ne", "e", "se", "s", "sw", "w", "nw", "n")
    files_too = _file_sql()
    mean = lambda rx, ry: f"WITH {_HOLES}, {_box(rx, ry, 'TRUE', 'z')} SELECT row, col, CASE WHEN z IS NOT NULL THEN round(s / n, 6) END AS z FROM b"
    return files_too | {
        "dem_stats": f"WITH {_HOLES} SELECT min(z) AS min_z, max(z) AS max_z, count(z) AS n_valid, count(*) AS n_cells FROM dem",
        "slope": f"{grad} SELECT row, col, CASE WHEN z IS NOT NULL THEN round(degrees(atan(sqrt(fx * fx + fy * fy))), 6) END AS z FROM g",
        "aspect": f"{grad} SELECT row, col, CASE WHEN z IS NULL THEN NULL WHEN fx = 0 THEN -1.0 ELSE round({_ASPECT}, 6) END AS z FROM g",
        "hillshade": f"{shade} SELECT row, col, z FROM shade",
        "hillshade_histogram": f"{shade} SELECT z, count(*) AS n FROM shade WHERE z IS NOT NULL GROUP BY z",
        "hillshade_trim": f"{cum} SELECT min(CASE WHEN a >= t THEN z END) AS display_min, max(CASE WHEN b >= t THEN z END) AS display_max FROM c",
        "mean_filter_3x3": mean(1, 1),
        "mean_filter_7x3": mean(3, 1),
        "deviation_from_mean": _deviation(3),
        "deviation_from_mean_traditional": _deviation(3, "TRUE", 2),
        "difference_from_mean": f"WITH {_HOLES}, {_box(3, 3, _INNER, 'z - lo')} SELECT row, col, CASE WHEN z IS NULL THEN NULL WHEN n > 0 THEN round(z - s / n, 6) ELSE 0.0 END AS z FROM b",
        "max_elevation_deviation": _scales(),
        "elevation_percentile": _percentile(),
        "quantiles": f"WITH {_HOLES}, {_FINE}, c AS (SELECT fine, least(floor(100.0 * sum(n) OVER (ORDER BY fine) / sum(n) OVER () / 20.0), 4) + 1 AS class FROM hist) SELECT row, col, CAST(class AS DOUBLE) AS z FROM t LEFT JOIN c USING (fine)",
        "fill_small_nodata_holes": f"WITH {_HOLES}, a AS (SELECT row, col, coalesce(z, (lag(z) OVER w + lead(z) OVER w) / 2) AS z FROM dem WINDOW w AS (PARTITION BY col ORDER BY row)) SELECT row, col, round(coalesce(z, (lag(z) OVER w + lead(z) OVER w) / 2), 6) AS z FROM a WINDOW w AS (PARTITION BY row ORDER BY col)",
        "d8_pointer": f"{near}, {_POINT} SELECT d.row, d.col, CAST(k AS BIGINT) AS direction FROM dem d LEFT JOIN best b ON d.row = b.row AND d.col = b.col",
        "d8_inflow_count": f"WITH {_DEM}, {_NEAR}, {_POINT}, i AS (SELECT row + dy AS r, col + dx AS c, count(*) AS n FROM best GROUP BY ALL) SELECT row, col, coalesce(n, 0) AS n FROM dem LEFT JOIN i ON row = r AND col = c",
        "d8_flow_accum": _d8_over(_DEM, "CAST(n AS DOUBLE)"),
        "d8_flow_accum_ln": _d8_over(_DEM, "round(ln(n), 6)"),
        "fd8_weights": f"{near}, falls AS ({_FALLS}) SELECT row, col, row + dy AS to_row, col + dx AS to_col, round(drop * drop / sum(drop * drop) OVER (PARTITION BY row, col), 6) AS w FROM falls",
        "fd8_flow_accum": _fd8_over(_DEM, "round(sum(v), 6)"),
        "edge_cells": f"{near} SELECT row, col, z FROM nb WHERE z IS NOT NULL AND ({' OR '.join(n + ' IS NULL' for n in names)})",
        "pit_cells": f"{near} SELECT row, col, z FROM nb WHERE {' AND '.join(n + ' >= z' for n in names)}",
        "integral_image": f"WITH {_HOLES}, a AS (SELECT row, col, sum(coalesce(z, 0)) OVER (PARTITION BY row ORDER BY col) AS s FROM dem) SELECT row, col, sum(s) OVER (PARTITION BY col ORDER BY row) AS s FROM a",
        "las_bitfields": f"""WITH b AS (SELECT event_id, CAST(event_id % 256 AS INTEGER) AS b FROM events)
SELECT event_id, b & 7 AS return_number, (b >> 3) & 7 AS number_of_returns, ((b >> 6) & 1) = 1 AS scan_direction, ((b >> 7) & 1) = 1 AS edge_of_flightline,
  b & 15 AS class_value, CASE b & 15 {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(points.CLASS_NAMES))} ELSE 'Undefined class value' END AS class_name,
  ((b >> 4) & 1) = 1 AS synthetic, ((b >> 5) & 1) = 1 AS key_point, ((b >> 6) & 1) = 1 AS withheld FROM b""",
        "las_scale_offset": "SELECT event_id, round(user_id * 0.01 + 100, 6) AS x, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 0.01 + 200, 6) AS y FROM events",
        "kd_radius_search": """WITH e AS (SELECT event_id, CAST(user_id AS DOUBLE) AS x, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS y FROM events)
SELECT q.event_id AS q_event_id, count(*) AS n, CAST(sum(p.event_id) AS BIGINT) AS sum_ids FROM e q JOIN e p
ON (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < 3600.0 WHERE q.event_id % 100 = 0 GROUP BY q.event_id""",
    }
