"""Formats: hand-made bytes, round trips, detection."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import registry
from ridgeline.__main__ import command
from ridgeline.operators import points
from ridgeline.plans import files
from ridgeline.sources import formats, geotiff, las, read_raster, write_raster
from ridgeline.sources.datasource import add_metadata, from_values
from ridgeline.sources.errors import AmbiguousFormat, DataError, MissingFile, OverwriteError, UnsupportedFormat, WriteError

Z = np.array([[1.0, 2.5, np.nan], [4.0, -5.0, 6.0]])
H = formats.EMPTY | {"rows": 2, "cols": 3, "west": 10.0, "south": 20.0, "east": 25.0, "north": 30.0, "crs_wkt": "PROJCS[x]"}


@pytest.mark.parametrize("name,ext", [("arcgis_ascii", ".asc"), ("arcgis_binary", ".flt"), ("grass_ascii", ".txt"), ("whitebox", ".dep"), ("idrisi", ".rst"), ("geotiff", ".tif")])
@pytest.mark.parametrize("order", ["LITTLE_ENDIAN", "BIG_ENDIAN"])
def test_round_trip(tmp_path, name, ext, order):
    path = str(tmp_path / f"a{ext}")
    _, c = formats.codec(path, name)
    formats.write(path, c, H | {"byte_order": order, "metadata": ["made: here"]}, Z)
    assert formats.detect(path) == name
    h = c.header(path)
    assert [h[k] for k in ("rows", "cols", "west", "south", "east", "north", "nodata")] == [2, 3, 10, 20, 25, 30, -32768]
    np.testing.assert_array_equal(c.rows(path, h, 0, 2), Z)
    np.testing.assert_array_equal(c.rows(path, h, 1, 2), Z[1:])


@pytest.mark.parametrize("name,ext", [("arcgis_ascii", ".asc"), ("arcgis_binary", ".flt"), ("grass_ascii", ".txt"), ("whitebox", ".dep"), ("idrisi", ".rst"), ("geotiff", ".tif")])
def test_distributed_round_trip(spark, tmp_path, name, ext):
    """Blocks of rows written by several tasks, some missing; read in blocks; header kept; save modes."""
    z = np.round(np.random.default_rng(1).normal(0, 100, (23, 7)))
    z[3, 2] = np.nan
    z[20:] = np.nan  # the last rows have no cells at all
    cells = [("g", r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(20) for c in range(7)]
    df = spark.createDataFrame(cells[::-1], "raster_id string, row int, col int, z double").repartition(5)
    path = str(tmp_path / f"a{ext}")
    h = H | {"rows": 23, "cols": 7, "east": 45.0, "north": 135.0, "metadata": ["made: here"], "display_min": -5.0, "display_max": 5.0, "nodata": -3.40282346638529e38}
    write_raster(df, path, h, name)
    got = spark.read.format("raster").option("blockCells", 30).load(path).toPandas()
    assert len(got) == 23 * 7
    back = np.full((23, 7), np.nan)
    back[got["row"], got["col"]] = got["z"]
    np.testing.assert_array_equal(back, z)
    _, c = formats.codec(path)
    kept = c.header(path)
    assert (kept["north"], kept["west"], kept["rows"]) == (135, 10, 23)
    if name in ("whitebox", "idrisi"):
        assert (kept["display_min"], kept["display_max"]) == (-5, 5) and "made" in " ".join(kept["metadata"])
    if name == "geotiff":
        assert any("made: here" in m for m in kept["metadata"]) and kept["crs_wkt"] == "PROJCS[x]"
    assert sorted(x.name for x in tmp_path.iterdir()) == sorted({os.path.basename(f) for f in formats.files(path, c)})
    with pytest.raises(OverwriteError):
        write_raster(df, path, h, name, mode="error")
    write_raster(df.limit(0), path, h, name, mode="ignore")
    assert spark.read.format("raster").load(path).filter("z is not null").count() == 139
    write_raster(df.limit(0), path, h, name)
    assert spark.read.format("raster").load(path).filter("z is not null").count() == 0


@pytest.mark.parametrize("nodata", [-3.40282346638529e38, -9999.9])
@pytest.mark.parametrize("name,ext", [("arcgis_binary", ".flt"), ("whitebox", ".dep"), ("idrisi", ".rst"), ("geotiff", ".tif")])
def test_no_data_is_rounded_as_cells_are(tmp_path, name, ext, nodata):
    path = str(tmp_path / f"a{ext}")
    _, c = formats.codec(path, name)
    formats.write(path, c, H | {"nodata": nodata}, Z)
    np.testing.assert_array_equal(c.rows(path, c.header(path), 0, 2), Z)


def test_text_blocks(tmp_path):
    """Values that break lines anywhere, read in blocks of rows by their bytes, across chunks."""
    z = np.arange(60.0).reshape(20, 3) * 1.5
    values = [repr(v) for v in z.ravel().tolist()]
    p = tmp_path / "a.asc"
    body = "".join(v + ("\n" if k % 7 == 3 else "  " if k % 5 else "\t") for k, v in enumerate(values))
    p.write_text("ncols 3\nnrows 20\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n" + body)
    h = formats.ArcAscii.header(str(p))
    for step in (1, 2, 7, 20, 50):
        for chunk in (5, 64, 1 << 20):
            got = formats.spans(str(p), h["_skip"], h, step, chunk)
            parts = [formats.ArcAscii.rows(str(p), h, r, min(20, r + step), got[r // step]) for r in range(0, 20, step)]
            np.testing.assert_array_equal(np.concatenate(parts), z)
    p.write_text(p.read_text()[:-20])
    with pytest.raises(DataError):
        formats.spans(str(p), h["_skip"], h, 4)


def test_palette(tmp_path):
    p = str(tmp_path / "p.tif")
    colours = [0xFF000000, 0xFFFF0000, 0xFF00FF00, 0xFF0102FE]
    z = np.array([[colours[1], colours[3], colours[0]], [colours[2]] * 3], float)
    formats.write(p, formats.GeoTiff, H | {"data_type": "PALETTED", "colours": colours}, z)
    assert formats.GeoTiff.header(p)["data_type"] == "PALETTED"
    np.testing.assert_array_equal(formats.GeoTiff.rows(p, formats.GeoTiff.header(p), 0, 2), z)


def test_named_errors(spark, tmp_path):
    with pytest.raises(MissingFile):
        read_raster(spark, str(tmp_path / "none.dep"))
    with pytest.raises(WriteError):
        write_raster(from_values(spark, [1], 1, 1), str(tmp_path / "no" / "a.flt"), H | {"rows": 1, "cols": 1})
    with pytest.raises(UnsupportedFormat):
        formats.codec("a.sdat")


def test_values_and_metadata(spark):
    df = from_values(spark, [1, None, 3, 4, 5, float("nan")], 2, 3)
    assert [tuple(r)[1:] for r in df.orderBy("row", "col").collect()][1::2] == [(0, 1, None), (1, 0, 4.0), (1, 2, None)]
    with pytest.raises(DataError):
        from_values(spark, [1, 2], 2, 3)
    assert add_metadata(H, "x")["metadata"] == ["x"] and H["metadata"] == []


def test_ascii_headers(tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("ncols 3\nnrows 2\nxllcenter 12.5\nyllcenter 22.5\ncellsize 5\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    h = formats.ArcAscii.header(str(p))
    assert formats.detect(str(p)) == "arcgis_ascii" and (h["west"], h["south"], h["east"], h["north"]) == (10, 20, 25, 30)
    g = tmp_path / "b.txt"
    g.write_text("north: 30\nsouth: 20\neast: 30\nwest: 10\nrows: 2\ncols: 2\n1 2\n* 4\n")
    h = formats.GrassAscii.header(str(g))
    np.testing.assert_array_equal(formats.GrassAscii.rows(str(g), h, 0, 2), [[1, 2], [np.nan, 4]])
    with pytest.raises(AmbiguousFormat):
        formats.detect(str(tmp_path / "none.txt"))
    with pytest.raises(UnsupportedFormat):
        formats.codec("x.grd")


def lzw(data: bytes) -> bytes:
    """A plain encoder for the decoder's test."""
    table, out, bits, width = {bytes([k]): k for k in range(256)}, 0, 0, 9

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    n, w = 258, b""
    for b in data:
        x = w + bytes([b])
        if x in table:
            w = x
            continue
        put(table[w])
        table[x], n, w = n, n + 1, bytes([b])
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
    if w:
        put(table[w])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def test_lzw_and_packbits():
    data = bytes(np.random.default_rng(0).integers(0, 9, 9000, dtype=np.uint8)) + b"aaaaaaaabbbb" * 300
    assert geotiff.unlzw(lzw(data)) == data
    assert geotiff.unpackbits(bytes([2, 1, 2, 3, 254, 7, 128])) == bytes([1, 2, 3, 7, 7, 7])


def tiff(path, tags, blocks, offset_tag):
    at = 10 + 12 * len(tags) + 4
    extra, entries = b"", []
    total = sum((len(v) * geotiff.FIELD[k][1] + 1) // 2 * 2 for _, k, v in tags if len(v) * geotiff.FIELD[k][1] > 4)
    place = at + total
    offsets = [place + sum(len(b) for b in blocks[:k]) for k in range(len(blocks))]
    for code, kind, v in sorted(tags):
        v = offsets if code == offset_tag else v
        raw = struct.pack("<" + geotiff.FIELD[kind][0] * len(v), *v)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", code, kind, len(v), at + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append(struct.pack("<HHI", code, kind, len(v)) + raw.ljust(4, b"\0"))
    path.write_bytes(b"II" + struct.pack("<HIH", 42, 8, len(tags)) + b"".join(entries) + b"\0" * 4 + extra + b"".join(blocks))


@pytest.mark.parametrize("compression,pack", [(1, bytes), (5, lzw), (8, zlib.compress), (32946, zlib.compress)])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiles(tmp_path, compression, pack, predictor):
    z = np.arange(20 * 18, dtype=np.uint8).reshape(20, 18) % 251
    blocks = []
    for r in (0, 16):
        for c in (0, 16):
            b = np.zeros((16, 16), np.uint8)
            part = z[r : r + 16, c : c + 16]
            b[: part.shape[0], : part.shape[1]] = part
            blocks.append(pack((np.diff(b, axis=1, prepend=0).astype(np.uint8) if predictor == 2 else b).tobytes()))
    tags = [
        (256, 3, [18]), (257, 3, [20]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor]), (322, 3, [16]), (323, 3, [16]),
        (324, 4, [0] * 4), (325, 4, [len(b) for b in blocks]), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0.0, 0, 0, 5, 50, 0]), (34735, 3, [1, 1, 0, 1, 1025, 0, 1, 1]),
    ]
    p = tmp_path / "t.tif"
    tiff(p, tags, blocks, 324)
    np.testing.assert_array_equal(geotiff.rows(str(p), 0, 20), z)
    np.testing.assert_array_equal(geotiff.rows(str(p), 15, 18), z[15:18])
    assert geotiff.header(str(p))["north"] == 50


def test_colours(tmp_path):
    p = str(tmp_path / "c.tif")
    z = np.array([[0xFF010203, 0xFF0A0B0C]], float)
    formats.write(p, formats.GeoTiff, H | {"data_type": "RGB24", "rows": 1, "cols": 2}, z)
    np.testing.assert_array_equal(geotiff.rows(p, 0, 1), z)
    formats.write(p, formats.GeoTiff, H | {"data_type": "RGBA32", "rows": 1, "cols": 2}, z - (1 << 24))
    np.testing.assert_array_equal(geotiff.rows(p, 0, 1), z - (1 << 24))


@pytest.mark.parametrize("shift", [0, 1 << 33])
def test_las_of_uneven_partitions(spark, tmp_path, shift):
    """Partitions without rows have no file, and several batches, repeated ids and ids beyond 32 bits are kept."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        few = spark.range(shift, shift + 300, 1, 3).filter(f"id < {shift + 200} and id != {shift}")  # the last of three is empty
        both = few.unionByName(few.filter(f"id >= {shift + 150}"))
        e = both.select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 86400).alias("ts"), (F.col("id") % 1000 / 100).alias("value"))
        at = files.las_files(spark, e)
        assert len(os.listdir(at)) == 3
        got = files.las_scan(spark, e)
        assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in e.collect())
        assert all(r["intensity"] == r["event_id"] % 65536 and r["y"] == r["event_id"] % 86400 + 100 for r in got.collect())
        info = files.las_info(spark, e).first()
        assert (info["n_points"], info["min_x"], info["max_x"]) == (249, shift + 1, shift + 199)
        assert files.las_scan(spark, e.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_las(spark, tmp_path):
    p = str(tmp_path / "p.las")
    raw = np.zeros(2, las.CORE)
    raw["x"], raw["flags"], raw["class"] = [100, 200], 0b11010001, 0b01100010
    las.write(p, raw, offset=(100.0, 200.0, 0.0), day=60, year=2016)
    got = registry.las_points(spark, p).orderBy("n").collect()
    assert [r["x"] for r in got] == [101.0, 102.0]
    r = got[0]
    assert (r["return_number"], r["number_of_returns"], r["scan_direction"], r["edge_of_flightline"]) == (1, 2, True, True)
    assert (r["class_value"], r["class_name"], r["synthetic"], r["key_point"], r["withheld"]) == (2, "Ground", False, True, True)
    info = registry.las_info(spark, p).first()
    assert (info["n_points"], str(info["created"]), info["version"]) == (2, "2016-02-29", "1.2")
    assert [str(las.created(d, y)) for d, y in ((59, 2016), (60, 2015), (366, 2016))] == ["2016-02-28", "2015-03-01", "2016-12-31"]


def test_tools_on_files(spark, tmp_path):
    z = np.add.outer(np.arange(6.0), np.arange(7.0))
    src = str(tmp_path / "dem.dep")
    formats.write(src, formats.Whitebox, H | {"rows": 6, "cols": 7, "east": 17.0, "north": 26.0}, z)
    for name, rest in (("Slope", []), ("quantiles", ["3"]), ("D8FlowAccumulation", ["true"]), ("FillDepressions", []), ("breachdepressions", []), ("Whitebox2GeoTiff", []), ("MeanFilter", ["3", "3"])):
        registry.run(spark, name, ["dem.dep", f"{name}.tif", *rest], str(tmp_path), lambda s: None)
        assert geotiff.rows(str(tmp_path / f"{name}.tif"), 0, 6).shape == (6, 7)
    np.testing.assert_array_equal(geotiff.rows(str(tmp_path / "Whitebox2GeoTiff.tif"), 0, 6), z)
    registry.run(spark, "MaxElevationDeviation", ["dem.dep", "m.tif", "s.flt"], str(tmp_path), lambda s: None)
    for name, want in (("Hillshade", None), ("DeviationFromMean", (-2.58, 2.58)), ("ElevationPercentile", (0, 100)), ("DifferenceFromMean", None), ("FillSmallNodataHoles", None)):
        registry.run(spark, name, ["dem.dep", f"{name}.dep"], str(tmp_path), lambda s: None)
        h = formats.Whitebox.header(str(tmp_path / f"{name}.dep"))
        assert h["palette"] == {"Hillshade": "grey.pal", "FillSmallNodataHoles": "grey.pal"}.get(name, "blue_white_red.plt") and f"Created by {name}" in h["metadata"]
        assert want is None or (h["display_min"], h["display_max"]) == want
        assert name != "DifferenceFromMean" or h["display_min"] == -h["display_max"]
    lat = str(tmp_path / "lat.dep")
    formats.write(lat, formats.Whitebox, H | {"rows": 6, "cols": 7, "east": 17.0, "north": 26.0, "south": 20.0, "crs_wkt": ""}, z)
    slopes = []
    for how in ({}, {"compat": True}, {"geographic": False}):
        registry.run(spark, "Slope", ["lat.dep", "o.flt"], str(tmp_path), lambda s: None, **how)
        slopes.append(float(formats.ArcBinary.rows(str(tmp_path / "o.flt"), formats.ArcBinary.header(str(tmp_path / "o.flt")), 2, 3)[0, 3]))
    assert slopes[0] != slopes[1] and slopes[2] > 10 > slopes[0]
    tags = registry.geotiff_tags(spark, str(tmp_path / "Slope.tif")).collect()
    assert ("image", 256, "ImageWidth") in {(t["section"], t["code"], t["name"]) for t in tags}
    df, h = read_raster(spark, src)
    assert df.count() == 42 and h["format"] == "whitebox"
    assert spark.read.format("raster_meta").load(src).first()["cols"] == 7


def test_names_and_prompt():
    assert registry.find("deviationfrommean").name == "DeviationFromMean"
    assert registry.find("MaxElevationDeviatio").name == "MaxElevationDeviation"
    state = {"folder": "/tmp"}
    assert "Slope" in command("listtools", state) and command("cwd /x", state) == "/x" and command("exit", state) is None
    assert command("bench", state).endswith("off") and command("benchon", state).endswith("on") and command("bench", state).endswith("on")
    assert "MB" in command("memprof", state) and all(w in command("help", state) for w in ("memprof", "toolargs", "licence")) and "unknown" in command("zzz", state)
    assert registry.set_working_folder("/tmp") == registry.working_folder() == "/tmp" and registry.version() == command("v", state)
    with pytest.raises(NotADirectoryError):
        registry.set_working_folder("/no/such")
    assert "NumBins" in command("toolhelp Quantiles", state) and "geotiff" in command("rasterformats", state)


def test_radius(spark):
    p = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(49)], "id int, x double, y double")
    got = {tuple(r) for r in points.within_radius(p, p, 1.5).select("q_id", "id").collect()}
    want = {(i, j) for i in range(49) for j in range(49) if (i % 7 - j % 7) ** 2 + (i // 7 - j // 7) ** 2 < 2.25}
    assert got == want and points.within_radius(p, p, -1.0).count() == 0
