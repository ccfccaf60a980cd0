"""Spark data sources ``raster``, ``raster_meta``, ``geotiff_tags``, ``las`` and ``las_header``.

Headers are read on the driver, values in row blocks (or record ranges) on the
executors, so files must be on a mount that all of them see.  ``raster`` is also
written in parallel: tasks put row blocks at their places (text: in files of
their own, which the commit puts together), and the commit writes the header and
gives the file its name.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import CELL_FIELDS, META_FIELDS, TAG_FIELDS
from . import geotiff, las
from .errors import DataError, DeleteError, MissingFile, OverwriteError, UnsupportedFormat, WriteError
from .formats import EMPTY, codec, ends, files, is_text, remove, spans

BLOCK_CELLS = 4_000_000
META_NAMES = [f.split()[0] for f in META_FIELDS.split(", ")]
HEADER_FIELDS = "file string, version string, created date, day int, year int, system_id string, software string, point_format int, record_length int, n_points long, n_vlrs int, points_by_return array<long>, x_scale double, y_scale double, z_scale double, x_offset double, y_offset double, z_offset double, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double"  # noqa: E501
RAW_FIELDS = "file string, n long, x double, y double, z double, intensity int, flags int, class_byte int, scan_angle int, user_data int, point_source_id int"


def paths(options) -> list[str]:
    at = options["path"].removeprefix("file://")
    found = sorted(glob.glob(at)) or [at]
    return [f for p in found for f in (sorted(os.path.join(p, x) for x in os.listdir(p) if x[0] != ".") if os.path.isdir(p) else [p])]


class Block(InputPartition):
    def __init__(self, path: str, first: int, end: int, span: tuple[int, int] | None = None) -> None:
        super().__init__((path, first, end, span))


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self):
        return [Block(p, 0, 1) for p in paths(self.options)]


class RasterReader(_Reader):
    def partitions(self):
        out = []
        for p in paths(self.options):
            _, c = codec(p, self.options.get("driver"))
            h = c.header(p)
            step = max(1, int(self.options.get("blockCells", BLOCK_CELLS)) // max(1, h["cols"]))
            where = spans(p, h["_skip"], h, step) if is_text(c) else None
            out += [Block(p, r, min(h["rows"], r + step), where and where[r // step]) for r in range(0, h["rows"], step)]
        return out

    def read(self, partition):
        path, first, end, span = partition.value
        _, c = codec(path, self.options.get("driver"))
        z = c.rows(path, c.header(path), first, end, span)
        rows, cols = z.shape
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([os.path.basename(path)] * z.size), pa.array(np.repeat(np.arange(first, end, dtype=np.int32), cols)),
                pa.array(np.tile(np.arange(cols, dtype=np.int32), rows)), pa.array(z.ravel(), from_pandas=True),
            ],
            ["raster_id", "row", "col", "z"],
        )


class MetaReader(_Reader):
    def read(self, partition):
        path = partition.value[0]
        name, c = codec(path, self.options.get("driver"))
        h = c.header(path) | {"raster_id": os.path.basename(path), "path": path, "format": name}
        yield tuple(h[k] for k in META_NAMES)


class TagReader(_Reader):
    def read(self, partition):
        path = partition.value[0]
        for row in geotiff.tag_rows(path):
            yield (path, *row)


class LasReader(_Reader):
    def partitions(self):
        step = int(self.options.get("blockPoints", 1_000_000))
        return [Block(p, k, min(n, k + step)) for p in paths(self.options) for n in [las.header(p)["n_points"]] for k in range(0, n, step)]

    def read(self, partition):
        if partition is None:  # a folder without files
            return
        path, first, end, _ = partition.value
        h = las.header(path)
        r = las.records(path, h, first, end)
        xyz = [r[a] * h[f"{a}_scale"] + h[f"{a}_offset"] for a in "xyz"]
        raw = [r[k].astype(np.int32) for k in ("intensity", "flags", "class", "angle", "user", "source")]
        names = [f.split()[0] for f in RAW_FIELDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(path)] * len(r)), pa.array(np.arange(first, end)), *map(pa.array, [*xyz, *raw])], names)


class LasHeaderReader(_Reader):
    def read(self, partition):
        if partition is None:
            return
        path = partition.value[0]
        h = las.header(path)
        first = (os.path.basename(path), f"{h['version_major']}.{h['version_minor']}", las.created(h["day"], h["year"]))
        yield (*first, *[h[f.split()[0]] for f in HEADER_FIELDS.split(", ")[3:]])


def _source(title: str, fields: str, reader: type, writes: type | None = None) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return fields

        def reader(self, schema):
            return reader(self.options)

        def writer(self, schema, overwrite):
            if writes is None:
                raise UnsupportedFormat(f"{title} can't be written")
            return writes(self.options)

    return Source


@dataclass
class Written(WriterCommitMessage):
    blocks: list[int]
    least: float
    most: float


class RasterWriter(DataSourceArrowWriter):
    """Blocks of rows of one grid; a task gets whole blocks, one after another (see ``write_raster``)."""

    def __init__(self, options) -> None:
        self.path, self.header = options["path"].removeprefix("file://"), json.loads(options["header"])
        self.driver, self.step = options.get("driver"), int(options["blockrows"])
        self.token = options.get("token", "")

    def _codec(self):
        return codec(self.path, self.driver)[1]

    def _offset(self, c) -> int:
        data, head = files(self.path, c)
        return len(c.head(self.header, 0.0, 0.0)) if head == data else 0

    def _put(self, c, block: int, z: np.ndarray) -> None:
        first = block * self.step
        raw = c.encode(self.header, z[: self.header["rows"] - first])
        if is_text(c):
            own = f"{self.path}.{self.token}.{block}.{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(raw)
            os.replace(own, f"{self.path}.{self.token}.{block}")
            return
        to = os.open(f"{self.path}.{self.token}", os.O_CREAT | os.O_WRONLY, 0o644)  # an attempt again writes the same bytes to the same place
        try:
            at, view = self._offset(c) + first * c.row_bytes(self.header), memoryview(raw)
            while view:
                n = os.pwrite(to, view, at)
                at, view = at + n, view[n:]
        finally:
            os.close(to)

    def write(self, batches):
        c, cols = self._codec(), self.header["cols"]
        now, z, done, range_ = None, None, [], []
        for b in batches:
            row, col = b.column("row").to_numpy(), b.column("col").to_numpy()
            value = b.column("z").to_numpy(zero_copy_only=False)
            block = row // self.step
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if now != block[x]:
                    if now is not None:
                        self._put(c, now, z)
                        range_.append(ends(z))
                    now, z = int(block[x]), np.full((self.step, cols), np.nan)
                    done.append(now)
                z[row[x:y] - now * self.step, col[x:y]] = value[x:y]
        if now is not None:
            self._put(c, now, z)
            range_.append(ends(z))
        return Written(done, min((r[0] for r in range_), default=0.0), max((r[1] for r in range_), default=0.0))

    def commit(self, messages) -> None:
        c, got = self._codec(), [m for m in messages if m is not None and m.blocks]
        have = {k for m in got for k in m.blocks}
        blocks = range(-(-self.header["rows"] // self.step))
        for k in blocks:
            if k not in have:  # no cell of these rows came: no-data
                self._put(c, k, np.full((self.step, self.header["cols"]), np.nan))
        head = c.head(self.header, min((m.least for m in got), default=0.0), max((m.most for m in got), default=0.0))
        data, head_at = files(self.path, c)
        made = f"{self.path}.{self.token}"
        if is_text(c):
            with open(made, "wb") as out:
                out.write(head)
                for k in blocks:
                    with open(f"{made}.{k}", "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 22)
                    os.remove(f"{made}.{k}")
        elif head_at == data:
            with open(made, "r+b" if os.path.exists(made) else "wb") as out:
                out.write(head)
        else:
            with open(head_at, "wb") as out:
                out.write(head)
            open(made, "ab").close()
        os.replace(made, data)

    def abort(self, messages) -> None:
        for f in glob.glob(glob.escape(f"{self.path}.{self.token}") + "*"):
            os.remove(f)


SOURCES = [
    _source("raster", CELL_FIELDS, RasterReader, RasterWriter), _source("raster_meta", META_FIELDS, MetaReader), _source("geotiff_tags", TAG_FIELDS, TagReader),
    _source("las", RAW_FIELDS, LasReader), _source("las_header", HEADER_FIELDS, LasHeaderReader),
]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)


def read_raster(spark: SparkSession, path: str, driver: str | None = None) -> tuple[DataFrame, dict]:
    """The cells of a grid file, and its header."""
    register(spark)
    reader = spark.read.format("raster")
    if driver:
        reader = reader.option("driver", driver)
    at = path.removeprefix("file://")
    if not os.path.exists(at):
        raise MissingFile(at)
    name, c = codec(at, driver)
    return reader.load(path), c.header(at) | {"format": name}


def add_metadata(header: dict, entry: str) -> dict:
    """The header with one more entry; Whitebox, Idrisi and GeoTIFF keep entries, the ASCII and ArcGIS formats have no place for them."""
    return header | {"metadata": [*(header.get("metadata") or []), entry]}


def from_values(spark: SparkSession, values, rows: int, cols: int, raster_id: str = "new") -> DataFrame:
    """A grid from its values, row by row; there must be one for each cell.  None and NaN are no-data."""
    z = np.asarray([np.nan if v is None else v for v in values], np.float64)
    if len(z) != rows * cols:
        raise DataError(f"{len(z)} values for {rows} x {cols} cells")
    at = np.arange(len(z))
    table = pa.table({"raster_id": [raster_id] * len(z), "row": (at // cols).astype(np.int32), "col": (at % cols).astype(np.int32), "z": pa.array(z, from_pandas=True)})
    return spark.createDataFrame(table)


def write_raster(df: DataFrame, path: str, header: dict, driver: str | None = None, mode: str = "overwrite") -> None:
    """Write one grid to one file (and its header's), in blocks of rows by as many tasks as there are partitions.

    Modes: ``overwrite`` replaces the file and its siblings, ``error`` raises where it
    exists, ``ignore`` leaves it.  Cells that aren't in ``df`` are no-data.
    """
    if mode not in ("overwrite", "error", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    path = path.removeprefix("file://")
    name, c = codec(path, driver)
    h = EMPTY | {k: v for k, v in header.items() if k in EMPTY or k == "colours"}
    if any(os.path.exists(f) for f in files(path, c)):
        if mode == "ignore":
            return
        if mode == "error":
            raise OverwriteError(path)
    c.head(h, 0.0, 0.0)  # what can't be written fails before anything is removed
    spark = df.sparkSession
    register(spark)
    step = min(max(1, BLOCK_CELLS // max(1, h["cols"])), max(1, -(-h["rows"] // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # some blocks share a task; a task writes one after another, so a block is all it holds
    blocks = df.select("raster_id", "row", "col", "z").withColumn("_b", F.floor(F.col("row") / step)).repartition("_b").sortWithinPartitions("_b").drop("_b")
    out = blocks.write.format("raster").mode("append").option("header", json.dumps(h)).option("blockRows", step).option("driver", name).option("token", uuid.uuid4().hex)
    if not os.access(os.path.dirname(os.path.abspath(path)), os.W_OK):
        raise WriteError(path)
    try:
        remove(path, c)
    except OSError as e:
        raise DeleteError(path) from e
    out.save(path)
