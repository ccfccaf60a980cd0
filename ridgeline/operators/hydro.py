"""Depression filling and breaching.

Filling runs over tiles: each floods its cells from the edges it has and from the
levels its neighbours have reached along its border, and tiles whose surroundings
fell flood again, until none does.  Breaching carves back along the order of one
flood over the whole grid.  Complete breaching floods windows that overlap, with
all that may come in over a window's rim marked: where the marks don't get to the
cells a window is for, their trenches are those of the whole flood.  Grids in which
they do, breaching with limits and along streams take a kernel over one grid each
(grids run in parallel), some 50 bytes a cell in one worker.
"""

from __future__ import annotations

import contextlib
import ctypes
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantisation
from ..model import DX, DY
from ..session import settled
from .grid import BROADCAST_ROWS, extremes, neighbours, with_small
from .tiles import SIDE, Tile, packed, rounds, unpacked


def edge_cells(df: DataFrame) -> DataFrame:
    """Valid cells next to no-data or the grid's border."""
    near = neighbours(df)
    missing = sum((F.col(n).isNull().cast("int") for n in ("NE", "E", "SE", "S", "SW", "W", "NW", "N")), F.lit(0))
    return near.filter(F.col("z").isNotNull() & (missing > 0)).select("raster_id", "row", "col", "z")


def pit_cells(df: DataFrame) -> DataFrame:
    """Valid cells with eight valid neighbours, none of them lower."""
    near = neighbours(df)
    names = ("NE", "E", "SE", "S", "SW", "W", "NW", "N")
    every = F.lit(True)
    for n in names:
        every = every & F.col(n).isNotNull()
    return near.filter(F.col("z").isNotNull() & every & (F.least(*names) >= F.col("z"))).select("raster_id", "row", "col", "z")


class Grid:
    """Values with a border of no-data, as one flat array, and which cells the table has."""

    def __init__(self, row: np.ndarray, col: np.ndarray, z: np.ndarray, size: tuple[int, int] | None = None) -> None:
        rows, cols = size or (int(row.max()) + 1, int(col.max()) + 1)
        self.width = cols + 2
        self.z = np.full((rows + 2) * self.width, np.nan)
        self.here = np.zeros(len(self.z), bool)
        self.steps = [dy * self.width + dx for dx, dy in zip(DX, DY, strict=True)]
        self.put(row, col, z)

    def put(self, row: np.ndarray, col: np.ndarray, z: np.ndarray) -> np.ndarray:
        at = self.places(row, col)
        self.z[at], self.here[at] = z, True
        return at

    def places(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row.astype(np.int64) + 1) * self.width + col + 1

    def inner(self):
        """Slices of all but the first and the last line, of so many cells that what is computed for one takes little."""
        for k in range(self.width + 1, len(self.z) - self.width - 1, BLOCK):
            yield k, min(k + BLOCK, len(self.z) - self.width - 1)

    def digits(self) -> int:
        least, most = np.fmin.reduce(self.z), np.fmax.reduce(self.z)
        return 1 if np.isnan(least) else len(str(int(most - least)))

    def marks(self, small: float, stream: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Heights in which a pit is just below its lowest neighbour (a shorter trench will do); pits inside the grid; edges."""
        z, raised = self.z, self.z + 0.0  # there is one zero only
        pits, edges = np.zeros(len(z), bool), np.zeros(len(z), bool)
        for a, b in self.inner():
            c = z[a:b]
            lower, missing, lowest = np.zeros(b - a, bool), np.zeros(b - a, bool), np.full(b - a, np.inf)  # lowest of those that aren't lower
            for s in self.steps:
                v = z[a + s : b + s]
                no, below = np.isnan(v), v < c
                missing |= no
                lowest = np.minimum(lowest, np.where(no | below, np.inf, v))
                # water of a stream stays in it: only lower stream cells count
                lower |= below if stream is None else below & (~stream[a:b] | stream[a + s : b + s])
            hollow = ~np.isnan(c) & ~lower
            lift = hollow & np.isfinite(lowest)
            raised[a:b][lift] = lowest[lift] - small
            edges[a:b] = missing & ~np.isnan(c)
            pits[a:b] = hollow & ~missing
        return raised, pits, edges


def _ranked(z: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of floats."""
    b = (z + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


BLOCK = 1 << 20  # cells
_PLACE, _CLEAN, _TOP, _ALL, _END = (1 << 36) - 1, 1 << 35, 1 << 63, (1 << 64) - 1, 1 << 200


def breach_kernel(
    g: Grid, small: float, mode: str = "complete", max_depth: float = math.inf, max_length: int = 1 << 31, stream: np.ndarray | None = None, rim: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray | None]:
    """The heights after breaching, and the cells of which that isn't sure.

    Beyond ``rim`` there is more, from where water may come at any time: what it
    reaches no later than water from the edges is not sure, nor where trenches from
    there may lead.  What is left is as in a flood of the whole grid, for marked
    water comes first wherever there is a tie, and clean cells keep their order.

    Cells wait as whole numbers: the height's rank, a bit for clean ones, the order
    of discovery, the place.  Edges, which come before all else of their height,
    are sorted and not in the heap.
    """
    z, pit, edge = g.marks(small, stream)
    if rim is not None:
        pit, edge = pit & ~rim, edge & ~rim
    pits, seen = pit.tobytes(), bytearray(np.isnan(g.z) | edge)
    del pit
    back, wet = bytearray(len(z)), None if stream is None else stream.tobytes()
    level_at, bits, original, steps = memoryview(z), memoryview(z.view(np.uint64)), memoryview(g.z), g.steps
    numbered = list(enumerate(steps, 1))
    tainted = None if rim is None else bytearray(len(z))
    heaps: tuple[list[int], list[int]] = ([], [])  # cells of streams are reached first

    at = np.flatnonzero(edge)
    first_of = np.ones(len(at), bool) if stream is None else ~stream[at]
    n = len(at)

    def entries(of: np.ndarray):
        rank = _ranked(g.z[at[of]])
        order = np.argsort(rank, kind="stable")
        for k in range(0, len(order), 1 << 16):
            o = order[k : k + (1 << 16)]
            for b, m, i in zip(rank[o].tolist(), of[o].tolist(), at[of[o]].tolist(), strict=True):
                yield b << 72 | (_CLEAN | m) << 36 | i

    edges = [entries(np.flatnonzero(~first_of)), entries(np.flatnonzero(first_of))]
    due = [next(e, _END) for e in edges]
    if rim is not None:
        for i in np.flatnonzero(rim & ~np.isnan(g.z)).tolist():
            seen[i] = tainted[i] = 1
            heaps[1].append(i)  # before all else
        heapq.heapify(heaps[1])

    def path(i: int):
        """Cells on the way out that are not yet below the falling trench, with the trench's level there."""
        level = level_at[i]
        while k := back[i]:
            level -= small
            if wet is not None and wet[i]:  # a stream runs below the lowest of the dry cells beside it
                beside = min((v for s in steps if not wet[i + s] and (v := level_at[i + s]) == v), default=math.inf)
                if beside < level:
                    level = beside - small
            i -= steps[k - 1]
            if level_at[i] <= level:
                return
            yield i, level

    while True:
        w = 0 if heaps[0] or due[0] is not _END else 1
        heap = heaps[w]
        if heap and heap[0] < due[w]:
            entry = heapq.heappop(heap)
        elif due[w] is _END:
            break
        else:
            entry = due[w]
            due[w] = next(edges[w], _END)
        i, clean = entry & _PLACE, entry >> 36 & _CLEAN
        for k, s in numbered:
            j = i + s
            if seen[j]:
                continue
            seen[j], back[j] = 1, k
            if not clean:
                tainted[j] = 1
            if pits[j]:
                trench = list(path(j))
                depth = 0.0 if mode == "complete" else max((original[c] - level for c, level in trench), default=0.0)
                if mode == "complete" or (len(trench) <= max_length and depth <= max_depth):
                    for c, level in trench:
                        level_at[c] = level
                elif mode == "constrained":  # as far and as deep as is allowed
                    for c, level in trench[:max_length]:
                        level_at[c] = min(level_at[c], max(level, original[c] - max_depth))
            n += 1
            b = bits[j]
            heapq.heappush(heaps[0 if wet is not None and wet[j] else 1], (b ^ _ALL if b >> 63 else b | _TOP) << 72 | (clean | n) << 36 | j)
    for a, b in g.inner():
        same = z[a:b] == g.z[a:b]
        z[a:b][same] = g.z[a:b][same]
    if rim is None:
        return z, None
    unsure = np.frombuffer(tainted, bool).copy()
    doubt = np.zeros(len(z), bool)
    for a, b in g.inner():
        for s in steps:
            doubt[a:b] |= unsure[a + s : b + s]
    for i in np.flatnonzero(doubt & ~unsure & ~np.isnan(z)).tolist():
        while not unsure[i]:
            unsure[i] = True
            if back[i]:
                i -= steps[back[i] - 1]
    return z, unsure


_CELL = "raster_id string, row int, col int, z double"


def _flooded(t: Tile, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Levels of a tile's cells (infinite where no water gets out yet) with its neighbours' levels at ring places."""
    edge = t.valid[np.isnan(t.around()).any(0)]
    level = np.full(len(t.z), np.inf)
    level[edge] = t.z[edge]
    level[places] = values
    todo = np.zeros(len(t.z), bool)
    todo[t.valid] = True
    todo[edge] = False
    levels, z, open_, steps, small = level.tolist(), t.z.tolist(), todo.tolist(), t.steps.tolist(), t.extra
    heap = [(levels[i], i) for i in (*edge.tolist(), *places.tolist())]
    heapq.heapify(heap)
    last = len(z) - 1
    while heap:
        v, i = heapq.heappop(heap)
        for s in steps:
            j = i + s
            if 0 <= j <= last and open_[j]:
                open_[j] = False
                levels[j] = w = z[j] if z[j] > v else v + small
                heapq.heappush(heap, (w, j))
    return np.array(levels)


def fill_depressions(df: DataFrame, fix_flats: bool = False, side: int = SIDE) -> DataFrame:
    """Each cell at the lowest level from which water gets out; ``fix_flats`` adds a small fall to filled flats."""

    def spread(t, places, values, first):
        level = _flooded(t, places, values)
        rim = t.perimeter()
        rim = rim[np.isfinite(level[rim])]
        return rim, level[rim], True

    def whole(t, places, values):
        return np.where(np.isnan(t.z), np.nan, _flooded(t, places, values))

    tiles = packed(df, side)
    if fix_flats:
        small = extremes(df).select("raster_id", (1 / quantisation(F.col("min_z"), F.col("max_z"))).alias("extra"))
        tiles = tiles.drop("extra").join(small, "raster_id").select("raster_id", "tr", "tc", "z", F.coalesce("extra", F.lit(0.0)).alias("extra"))
    return unpacked(tiles, rounds(tiles, spread, "min", side), whole, side)


WINDOW, HALO = (2048, 512), 256  # rows and columns, cells on every side


def _windows(df: DataFrame, window: tuple[int, int], halo: int) -> DataFrame:
    """Complete breaching of windows: ``(raster_id, row, col, z, sure)``."""
    over = lambda c, size: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / size).cast("int") for d in (0, -halo, halo)])))
    digits = extremes(df).select("raster_id", F.coalesce(F.length((F.col("max_z") - F.col("min_z")).cast("long").cast("string")), F.lit(1)).alias("digits"))
    cells = with_small(df, digits, ["raster_id"]).withColumn("wr", over("row", window[0])).withColumn("wc", over("col", window[1]))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        top, left = int(p["wr"].iloc[0]) * window[0], int(p["wc"].iloc[0]) * window[1]
        row, col = p["row"].to_numpy() - (top - halo), p["col"].to_numpy() - (left - halo)
        core = (row >= halo) & (row < halo + window[0]) & (col >= halo) & (col < halo + window[1])
        if not core.any():
            return pd.DataFrame(columns=["raster_id", "row", "col", "z", "sure"])
        g = Grid(row, col, p["z"].to_numpy(np.float64))
        at = g.places(row, col)
        rim = np.zeros(len(g.z), bool)
        rim[at[(row == 0) | (col == 0) | (row == window[0] + 2 * halo - 1) | (col == window[1] + 2 * halo - 1)]] = True
        z, unsure = breach_kernel(g, 10 / 10 ** (5 - int(p["digits"].iloc[0])), rim=rim)
        return p.loc[core, ["raster_id", "row", "col"]].assign(z=z[at[core]], sure=~unsure[at[core]])

    return cells.groupBy("raster_id", "wr", "wc").applyInPandas(run, f"{_CELL}, sure boolean")


def _whole(df: DataFrame, mode: str, max_depth: float = math.inf, max_length: int = 1 << 31) -> DataFrame:
    """Breaching of one grid after another; a column ``m`` marks streams (over 0).  Cells come and go in batches, in between there is the grid only."""
    names = ["row", "col", "z", *(["m"] if "m" in df.columns else [])]

    def carved(raster_id: str | None, parts: list[list[np.ndarray]]):
        size = (max(int(p[0].max()) for p in parts) + 1, max(int(p[1].max()) for p in parts) + 1)
        g = Grid(*parts[0][:3], size)
        stream = np.zeros(len(g.z), bool) if len(names) > 3 else None
        while parts:
            row, col, z, *wet = parts.pop()
            at = g.put(row, col, z)
            if wet:
                stream[at] = wet[0]
        with contextlib.suppress(OSError, AttributeError):  # not glibc
            ctypes.CDLL(None).malloc_trim(0)  # the parts' memory would stay beside the flood's
        small = 10 / 10 ** (5 - g.digits()) if stream is None else 1 / 10 ** (8 - g.digits())
        z, _ = breach_kernel(g, small, mode, max_depth, max_length, stream)
        for a, b in g.inner():
            for k in range(a, b, 1 << 16):
                at = k + np.flatnonzero(g.here[k : min(b, k + (1 << 16))])
                row, col = np.divmod(at, g.width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raster_id] * len(at), pa.string()), pa.array((row - 1).astype(np.int32)), pa.array((col - 1).astype(np.int32)), pa.array(z[at], from_pandas=True)],
                    ["raster_id", "row", "col", "z"],
                )

    def run(batches):
        now, got = None, None
        for b in batches:
            ids = b.column("raster_id").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if got is not None and ids[x] != now:
                    yield from carved(now, got)
                    got = None
                now, got = ids[x], got or []
                row, col, z, *m = [b.column(k).slice(x, y - x).to_numpy(zero_copy_only=False) for k in names]
                got.append([row.astype(np.int32), col.astype(np.int32), z.astype(np.float64), *(v > 0 for v in m)])  # copies: the batch goes
        if got is not None:
            yield from carved(now, got)

    return df.select("raster_id", *names).repartition("raster_id").sortWithinPartitions("raster_id").mapInArrow(run, _CELL)


def breach_depressions(
    df: DataFrame, mode: str = "complete", max_depth: float = math.inf, max_length: int = 1 << 31, then_fill: bool = False, window: tuple[int, int] = WINDOW, halo: int = HALO
) -> DataFrame:
    """Trenches from pits to lower ground; modes ``complete``, ``selective`` (whole trenches within the limits) and ``constrained`` (partial ones too)."""
    if mode not in ("complete", "selective", "constrained"):
        raise ValueError(f"unknown mode {mode!r}")
    cells = df.select("raster_id", "row", "col", "z")
    if mode == "complete":
        parts = settled(_windows(cells, window, halo))
        wide = settled(parts.filter("not sure").select("raster_id").distinct())
        out = parts.drop("sure")
        if n := wide.count():
            wide = F.broadcast(wide) if n <= BROADCAST_ROWS else wide
            out = out.join(wide, "raster_id", "left_anti").unionByName(_whole(cells.join(wide, "raster_id", "left_semi"), mode))
    else:
        out = _whole(cells, mode, max_depth, max_length)
    return fill_depressions(out) if then_fill else out


def breach_streams(dem: DataFrame, streams: DataFrame) -> DataFrame:
    """Complete breaching in which the flood follows stream cells (mask over 0) first; both grids must have the same cells.

    Trenches lead along a stream as far as it goes, and depend on those before: the flood isn't parted.
    """
    both = dem.select("raster_id", "row", "col", "z").join(streams.select("raster_id", "row", "col", F.col("z").alias("m")), ["raster_id", "row", "col"], "full")
    return _whole(both, "complete")
