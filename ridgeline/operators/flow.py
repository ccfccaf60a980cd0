"""Flow pointers and accumulation.

Accumulation runs over tiles: water goes down the cells of a tile in the order of
their heights, each cell once, and what leaves a tile enters its neighbour in the
next round, so the rounds are the tiles that the longest path crosses.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DX, DY, NAMES
from .grid import neighbours
from .tiles import SIDE, Tile, packed, rounds, unpacked


def d8_pointers(df: DataFrame, size_x: float, size_y: float) -> DataFrame:
    """``direction`` 0 to 7 of the steepest descent, the first on ties; null at sinks; ``z`` stays."""
    near = neighbours(df)
    diagonal = math.hypot(size_x, size_y)
    falls = []
    for k, name in enumerate(NAMES):
        length = diagonal if DX[k] and DY[k] else size_x if DX[k] else size_y
        fall = (F.col("z") - F.col(name)) / length
        falls.append(F.when(fall > 0, F.struct(fall.alias("fall"), F.lit(-k).alias("k"))))
    best = F.array_max(F.array(*falls))
    return near.select("raster_id", "row", "col", "z", (-best["k"]).cast("int").alias("direction"))


def _targets(pointers: DataFrame) -> DataFrame:
    dx, dy = (F.array(*[F.lit(v) for v in d]) for d in (DX, DY))
    return pointers.withColumns({
        "to_row": F.col("row") + F.get(dy, F.col("direction")), "to_col": F.col("col") + F.get(dx, F.col("direction")),
    })


def inflow_count(pointers: DataFrame) -> DataFrame:
    """How many neighbours point at each cell."""
    p = _targets(pointers)
    into = p.filter("to_row is not null").groupBy("raster_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("raster_id", "row", "col", "z").join(into, ["raster_id", "row", "col"], "left").select(
        "raster_id", "row", "col", F.when(F.col("z").isNotNull(), F.coalesce(F.col("n"), F.lit(0))).alias("n")
    )


def _d8_shares(t: Tile, size_x: float, size_y: float) -> np.ndarray:
    """Share of its water that each valid cell gives each neighbour: all to the steepest descent, the first on ties."""
    diagonal = math.hypot(size_x, size_y)
    lengths = np.array([diagonal if dx and dy else size_x if dx else size_y for dx, dy in zip(DX, DY, strict=True)])
    fall = np.nan_to_num((t.z[t.valid] - t.around()) / lengths[:, None], nan=-np.inf)
    best = fall.argmax(0)
    out = np.zeros_like(fall)
    at = np.arange(fall.shape[1])
    out[best, at] = fall[best, at] > 0
    return out


def _fd8_shares(t: Tile) -> np.ndarray:
    """In proportion to the squared falls to lower neighbours."""
    fall = np.nan_to_num(np.maximum(0, t.z[t.valid] - t.around()))
    square = fall * fall
    return square / np.maximum(square.sum(0), np.finfo(float).tiny)


def _drained(t: Tile, shares: np.ndarray, places: np.ndarray, values: np.ndarray, first: bool) -> np.ndarray:
    """What passes each cell of a tile, and what arrives in its ring, when ``values`` come in (and 1 to every cell, at first)."""
    acc = np.zeros(len(t.z))
    np.add.at(acc, places, values)
    if not first:
        return _trickled(t, shares, acc, places)
    acc[t.valid] += 1.0
    water = acc.tolist()
    order = np.argsort(-t.z[t.valid], kind="stable")
    for i, own, to in zip(t.valid[order].tolist(), shares.T[order].tolist(), (t.valid[order][:, None] + t.steps).tolist(), strict=True):
        if w := water[i]:
            for share, j in zip(own, to, strict=True):
                if share:
                    water[j] += w * share
    return np.array(water)


def _trickled(t: Tile, shares: np.ndarray, water: np.ndarray, places: np.ndarray) -> np.ndarray:
    """As above for a little water: only the cells it reaches are visited, the highest first."""
    column = np.full(len(t.z), -1)
    column[t.valid] = np.arange(len(t.valid))
    due = {int(i) for i in places}
    queue = [(-t.z[i], i) for i in due]
    heapq.heapify(queue)
    while queue:
        _, i = heapq.heappop(queue)
        for k, share in enumerate(shares[:, column[i]].tolist()):
            if share:
                j = int(i + t.steps[k])
                water[j] += water[i] * share
                if column[j] >= 0 and j not in due:
                    due.add(j)
                    heapq.heappush(queue, (-t.z[j], j))
    return water


def _accumulated(df: DataFrame, shares, log: bool, side: int) -> DataFrame:
    def leaving(t, places, values, first):
        water = _drained(t, shares(t), places, values, first)
        out = np.flatnonzero(t.ring & (water > 0))
        return out, water[out], False

    def whole(t, places, values):
        return np.where(np.isnan(t.z), np.nan, _drained(t, shares(t), places, values, True))

    tiles = packed(df, side)
    out = unpacked(tiles, rounds(tiles, leaving, "sum", side), whole, side)
    return out.withColumn("z", F.log("z")) if log else out


def d8_accumulation(df: DataFrame, size_x: float, size_y: float, log: bool = False, compat: bool = False, side: int = SIDE) -> DataFrame:
    """Cells that drain through each cell, itself included; no-data stays null (``compat``: 1)."""
    out = _accumulated(df, lambda t: _d8_shares(t, size_x, size_y), False, side)
    if compat:
        out = out.withColumn("z", F.coalesce("z", F.lit(1.0)))
    return out.withColumn("z", F.log("z")) if log else out


def fd8_inflow_count(df: DataFrame) -> DataFrame:
    """How many neighbours are higher than each cell."""
    near = neighbours(df)
    n = sum((F.coalesce((F.col(k) > F.col("z")).cast("int"), F.lit(0)) for k in NAMES), F.lit(0))
    return near.select("raster_id", "row", "col", F.when(F.col("z").isNotNull(), n).alias("n"))


def fd8_edges(df: DataFrame) -> DataFrame:
    """``(raster_id, row, col, to_row, to_col, w)``: shares of the squared falls to lower neighbours."""
    near = neighbours(df)
    falls = [
        F.when(F.col(n) < F.col("z"), F.struct((F.col("z") - F.col(n)) .alias("f"), F.lit(DY[k]).alias("dy"), F.lit(DX[k]).alias("dx"))) for k, n in enumerate(NAMES)
    ]
    lower = F.filter(F.array(*falls), lambda x: x.isNotNull())
    near = near.select("raster_id", "row", "col", lower.alias("l"))
    near = near.withColumn("t", F.aggregate("l", F.lit(0.0), lambda a, x: a + x["f"] * x["f"]))
    e = near.select("raster_id", "row", "col", "t", F.explode("l").alias("x"))
    return e.select("raster_id", "row", "col", (F.col("row") + F.col("x.dy")).alias("to_row"), (F.col("col") + F.col("x.dx")).alias("to_col"), (F.col("x.f") * F.col("x.f") / F.col("t")).alias("w"))


def fd8_accumulation(df: DataFrame, log: bool = False, side: int = SIDE) -> DataFrame:
    """Accumulation shared over all lower neighbours; no-data stays null."""
    return _accumulated(df, _fd8_shares, log, side)
