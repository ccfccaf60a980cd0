"""Square tiles of a grid as packed arrays, and what passes between neighbouring tiles.

Operators in which a cell depends on cells far away (floods, accumulation) run as
kernels over tiles; only values along the tiles' borders travel, in rounds, until
nothing changes.  A tile has a ring of its neighbours' cells around it.  Tiles are
written once to the shared folder; a round reads those that got something new.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DX, DY
from ..session import forget, settled
from .grid import BROADCAST_ROWS

SIDE = 512  # cells; a tile is some two megabytes
KEY = ["raster_id", "tr", "tc"]
_TILE = "raster_id string, tr int, tc int, z binary"
_RING = "raster_id string, tr int, tc int, pos int, v double"


class Tile:
    """Values with the ring, as one flat array; NaN is no-data or no cell."""

    def __init__(self, side: int, z: bytes, extra: float) -> None:
        self.side, self.width, self.extra = side, side + 2, extra
        raw = np.frombuffer(z, np.float64)
        self.z = np.where(np.isneginf(raw), np.nan, raw)
        inner = np.zeros((side + 2, side + 2), bool)
        inner[1:-1, 1:-1] = True
        self.ring = ~inner.ravel()
        self.cells = np.flatnonzero(inner.ravel() & ~np.isneginf(raw))  # that are in the table, with or without data
        self.valid = self.cells[~np.isnan(self.z[self.cells])]
        self.steps = np.array([dy * self.width + dx for dx, dy in zip(DX, DY, strict=True)])

    def around(self) -> np.ndarray:
        """The eight neighbours' values of each valid cell, (8, cells)."""
        return self.z[self.valid + self.steps[:, None]]

    def perimeter(self) -> np.ndarray:
        row, col = np.divmod(self.valid, self.width)
        return self.valid[(row == 1) | (row == self.side) | (col == 1) | (col == self.side)]


def packed(df: DataFrame, side: int = SIDE) -> DataFrame:
    """``(raster_id, tr, tc, z, extra)`` for each tile; border cells also go to the tiles whose ring they are in.

    A table has one row for each cell; of repeated ones any counts.
    """
    both = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side).cast("int") for d in (0, -1, 1)])))
    cells = df.select("raster_id", "row", "col", "z").withColumn("tr", both("row")).withColumn("tc", both("col"))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(p["tr"].iloc[0]), int(p["tc"].iloc[0])
        row, col = p["row"].to_numpy() - tr * side, p["col"].to_numpy() - tc * side
        if not ((row >= 0) & (row < side) & (col >= 0) & (col < side)).any():
            return pd.DataFrame(columns=[*KEY, "z"])  # a ring and nothing in it
        z = np.full((side + 2, side + 2), -np.inf)  # no cell
        z[row + 1, col + 1] = p["z"].to_numpy(np.float64)
        return pd.DataFrame([{"raster_id": p["raster_id"].iloc[0], "tr": tr, "tc": tc, "z": z.tobytes()}])

    return settled(cells.groupBy(*KEY).applyInPandas(pack, _TILE).withColumn("extra", F.lit(0.0)))


def _sent(tile: Tile, tr: int, tc: int, cells: np.ndarray, values: np.ndarray, to_ring: bool) -> list[tuple]:
    """``(tr, tc, pos, v)`` for other tiles.

    With ``to_ring`` the cells are the tile's own and arrive in the rings of all
    tiles beside them; otherwise they are ring cells and arrive at their owners.
    ``pos`` is the place in the other tile's array.
    """
    out, side, width = [], tile.side, tile.width
    for c, v in zip(cells.tolist(), values.tolist(), strict=True):
        r, k = c // width, c % width
        if to_ring:
            for dr in (-1, 0, 1):
                for dk in (-1, 0, 1):
                    rr, kk = r - dr * side, k - dk * side
                    if (dr or dk) and 0 <= rr < width and 0 <= kk < width:
                        out.append((tr + dr, tc + dk, rr * width + kk, v))
        else:
            dr, dk = (r - 1) // side, (k - 1) // side
            out.append((tr + dr, tc + dk, (r - dr * side) * width + k - dk * side, v))
    return out


def _arrivals(got) -> tuple[np.ndarray, np.ndarray]:
    got = got or []
    return np.array([g["pos"] for g in got], np.int64), np.array([g["v"] for g in got], np.float64)


def _passed(kernel: Callable, first: bool, side: int):
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches):
        for b in batches:
            out = []
            for raster_id, tr, tc, z, extra, got in zip(*[b.column(c).to_pylist() for c in (*KEY, "z", "extra", "got")], strict=True):
                t = Tile(side, z, extra)
                out += [(raster_id, *x) for x in _sent(t, tr, tc, *kernel(t, *_arrivals(got), first))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*KEY, "pos", "v"])

    return run


def rounds(tiles: DataFrame, kernel: Callable, combine: str, side: int = SIDE) -> DataFrame:
    """What has arrived at each tile once nothing new does: ``(raster_id, tr, tc, pos, v)``.

    ``kernel(tile, places, values, first)`` gives ``(cells, values, to_ring)`` for the
    other tiles.  With ``combine`` "sum" a round passes on what arrived in the one
    before, and arrivals add up; with "min" a tile that got something smaller sees
    all that it has.  Every round is settled and the one before it deleted.
    """
    spark, joined = tiles.sparkSession, F.sum if combine == "sum" else F.min

    def passed(given: DataFrame, first: bool) -> DataFrame:
        return given.mapInArrow(_passed(kernel, first, side), _RING)

    first = passed(tiles.withColumn("got", F.lit(None).cast("array<struct<pos:int,v:double>>")), True)
    state = settled(first.groupBy(*KEY, "pos").agg(joined("v").alias("v")).withColumn("fresh", F.col("v")))
    while n := state.filter("fresh is not null").count():
        new = state.filter("fresh is not null")
        due = new.select(*KEY, "pos", F.col("fresh").alias("v")) if combine == "sum" else state.join(new.select(*KEY).distinct(), KEY, "left_semi")
        sent = passed(tiles.join(_gathered(due, n if combine == "sum" else state.count()), KEY), False)
        none = F.lit(None).cast("double")
        both = sent.withColumn("had", none).unionByName(state.select(*KEY, "pos", none.alias("v"), F.col("v").alias("had")))
        both = both.groupBy(*KEY, "pos").agg(joined("v").alias("v"), F.max("had").alias("had"))
        if combine == "sum":
            v, fresh = F.coalesce("had", F.lit(0.0)) + F.coalesce("v", F.lit(0.0)), F.col("v")
        else:
            v, fresh = F.least("v", "had"), F.when(F.col("had").isNull() | (F.col("v") < F.col("had")), F.col("v"))
        old, state = state, settled(both.select(*KEY, "pos", v.alias("v"), fresh.alias("fresh")))
        forget(spark, old)
    return state.drop("fresh")


def _gathered(arrived: DataFrame, n: int) -> DataFrame:
    """What arrived, a row for each tile (a ring's or a border's cells at most); broadcast if it is small, so that tiles stay where they are."""
    got = arrived.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "v")).alias("got"))
    return F.broadcast(got) if n <= BROADCAST_ROWS else got


def unpacked(tiles: DataFrame, arrived: DataFrame, kernel: Callable, side: int = SIDE) -> DataFrame:
    """The cells ``(raster_id, row, col, z)`` from ``kernel(tile, places, values)``, which gives the tile's array anew."""

    def run(batches):
        for b in batches:
            for raster_id, tr, tc, z, extra, got in zip(*[b.column(c).to_pylist() for c in (*KEY, "z", "extra", "got")], strict=True):
                t = Tile(side, z, extra)
                new = kernel(t, *_arrivals(got))[t.cells]
                row, col = np.divmod(t.cells, t.width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([raster_id] * len(new)), pa.array((row - 1 + tr * side).astype(np.int32)), pa.array((col - 1 + tc * side).astype(np.int32)),
                        pa.array(new, from_pandas=True),
                    ],
                    ["raster_id", "row", "col", "z"],
                )

    return tiles.join(_gathered(arrived, arrived.count()), KEY, "left").mapInArrow(run, "raster_id string, row int, col int, z double")
