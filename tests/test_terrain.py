"""Hand-sized grids with expected values."""

import math
import tracemalloc

import numpy as np
import pytest

from ridgeline.model import DX, DY
from ridgeline.operators import flow, focal, hydro, local, stats

PLANE = [[c for c in range(5)] for _ in range(5)]
PIT = [[9, 8, 7, 6], [8, 3, 5, 4], [7, 5, None, 3], [6, 4, 3, 1]]
BOWL = [[9] * 5, [9, 5, 5, 5, 9], [9, 5, 1, 5, 9], [9, 5, 5, 5, 9], [9, 9, 7, 9, 9]]


def frame(spark, grid):
    rows = [("g", r, c, None if v is None else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, z double")


def grid(df, column="z"):
    got = df.collect()
    out = [[None] * (max(r["col"] for r in got) + 1) for _ in range(max(r["row"] for r in got) + 1)]
    for r in got:
        out[r["row"]][r["col"]] = None if r[column] is None else round(r[column], 4)
    return out


def test_plane(spark):
    p = frame(spark, PLANE)
    assert grid(local.slope(p, 1))[0] == [21.5681, 36.8699, 36.8699, 36.8699, 21.5681]
    assert grid(local.slope(p, 1))[2] == [26.5651, 45, 45, 45, 26.5651]
    assert grid(local.aspect(p, 1))[0] == [288.4349, 270, 270, 270, 251.5651]
    assert grid(local.hillshade(p, 1))[0] == [191, 195, 195, 195, 154]
    assert grid(focal.mean_filter(p))[1] == [0.5, 1, 2, 3, 3.5]
    assert grid(focal.difference_from_mean(p))[3] == [-1, -0.5, 0, 0, 0.5]
    assert grid(focal.deviation_from_mean(p))[0] == [0, -1, 0, 0, 1]
    assert grid(stats.quantiles(p, 5))[4] == [2, 3, 4, 5, 5]
    assert grid(focal.elevation_percentile(p, 1, 5))[2] == [0, 50, 66.6667, 66.6667, 100]
    assert grid(flow.d8_accumulation(p, 1, 1))[1] == [5, 4, 3, 2, 1]
    fd8 = grid(flow.fd8_accumulation(p))
    assert fd8[0] == [4.1968, 3.4213, 2.6389, 1.8333, 1] and fd8[2] == [5.3858, 4.2407, 3.1111, 2, 1]


def test_pit_and_hole(spark):
    p = frame(spark, PIT)
    assert grid(local.slope(p, 1))[1] == [61.5499, 64.7606, 51.8871, 52.1518]
    assert grid(local.aspect(p, 1))[2] == [105.2551, 101.3099, None, 165.9638]
    assert grid(local.hillshade(p, 1)) == [[0, 0, 0, 8], [0] * 4, [0, 0, None, 0], [8, 0, 0, 0]]
    assert grid(focal.mean_filter(p))[3] == [5.5, 5, 3.2, 2.3333]
    assert grid(focal.difference_from_mean(p))[2] == [3, 1, None, -0.2]
    assert grid(focal.deviation_from_mean(p))[0] == [0, 4, 3.6742, 3]
    assert grid(stats.quantiles(p, 3))[3] == [3, 2, 1, 1]
    assert grid(focal.elevation_percentile(p, 1, 3))[3] == [100, 66.6667, 60, 25]
    assert grid(flow.d8_accumulation(p, 1, 1)) == [[1] * 4, [1, 8, 1, 2], [1, 1, None, 3], [1, 2, 3, 7]]
    assert grid(flow.d8_accumulation(p, 1, 1, compat=True))[2][2] == 1
    assert grid(flow.fd8_accumulation(p))[3] == [1.0343, 2.3149, 4.0296, 9.0592]


def test_fill_and_breach(spark):
    b = frame(spark, BOWL)
    filled = grid(hydro.fill_depressions(b))
    assert [r[1:4] for r in filled[1:4]] == [[7, 7, 7]] * 3 and filled[4] == BOWL[4]
    sloped = hydro.fill_depressions(b, True).orderBy("row", "col").toPandas()["z"].to_numpy().reshape(5, 5)
    assert np.allclose(sloped[1:4, 2], [7 + 3e-7, 7 + 2e-7, 7 + 1e-7], atol=1e-9)
    carved = np.array(grid(hydro.breach_depressions(b)))
    assert carved[2, 2] == 4.999 and carved[4, 2] == 4.997 and sorted(carved[3, 1:4]) == [4.998, 5, 5]
    kept = hydro.breach_depressions(b, "selective", max_depth=0.5)
    assert grid(kept)[4] == BOWL[4]
    assert np.array(grid(hydro.breach_depressions(b, "selective", max_depth=0.5, then_fill=True))).min() >= 7


def test_holes(spark):
    g = frame(spark, [[1, 2, 3, 4, 5], [1, None, 3, None, 5], [1, 2, None, 4, 5], [1, 2, 3, 4, 5]])
    assert grid(focal.fill_small_nodata_holes(g)) == [[1, 2, 3, 4, 5]] * 4
    old = grid(focal.fill_small_nodata_holes(g, compat=True))
    assert old[0] == [None] * 5 and old[1] == [1, 2, 3, 4, 5]


def test_scales_agree_with_one_radius(spark):
    p = frame(spark, PIT)
    one, many = grid(focal.deviation_from_mean(p, 1)), grid(focal.max_elevation_deviation(p, 1, 1), "magnitude")
    assert all(b is None or a == b for x, y in zip(one, many, strict=True) for a, b in zip(x, y, strict=True))


def test_errors_and_flat(spark):
    with pytest.raises(ValueError):
        focal.mean_filter(frame(spark, PLANE), 4)
    flat = frame(spark, [[2, 2], [2, 2]])
    assert grid(stats.quantiles(flat, 3)) == [[3, 3], [3, 3]]
    assert grid(local.aspect(flat, 1)) == [[-1, -1], [-1, -1]]
    assert math.isclose(sum(v for r in grid(flow.fd8_accumulation(frame(spark, PLANE))) for v in r if v), 5 * 15, rel_tol=0.5)


def rough(seed, rows, cols, holes=0.05, levels=40, tilt=0.0):
    r = np.random.default_rng(seed)
    z = r.integers(0, levels, (rows, cols)).astype(float) + tilt * np.add.outer(np.arange(rows), np.arange(cols))
    z[r.random((rows, cols)) < holes] = np.nan
    return z


def cells(spark, grids):
    rows = [(name, r, c, None if np.isnan(v) else float(v)) for name, z in grids.items() for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "raster_id string, row int, col int, z double").repartition(3)


def arrays(df):
    out = {}
    for name, p in df.toPandas().groupby("raster_id"):
        z = np.full((p["row"].max() + 1, p["col"].max() + 1), np.nan)
        assert not p.duplicated(["row", "col"]).any() and len(p) == z.size
        z[p["row"], p["col"]] = p["z"].astype(float)
        out[name] = z
    return out


def around(z):
    wide = np.pad(z, 1, constant_values=np.nan)
    return np.stack([wide[1 + dy : 1 + dy + z.shape[0], 1 + dx : 1 + dx + z.shape[1]] for dx, dy in zip(DX, DY, strict=True)])


def filled_by_force(z, small=0.0):
    """The least fixpoint: levels fall until each cell is at its own height or just above its lowest neighbour's level."""
    edge = ~np.isnan(z) & np.isnan(around(z)).any(0)
    level = np.where(edge, z, np.where(np.isnan(z), np.nan, np.inf))
    while True:
        low = np.nanmin(np.where(np.isnan(around(level)), np.inf, around(level)), 0)
        new = np.where(edge | np.isnan(z), level, np.minimum(level, np.where(z > low, z, low + small)))
        if np.array_equal(new, level, equal_nan=True):
            return level
        level = new


@pytest.mark.parametrize("side", [5, 256])
def test_tiles_agree_with_brute_force(spark, side):
    grids = {"a": rough(1, 23, 17), "b": rough(2, 11, 30, 0.0, 6), "c": rough(3, 9, 9, 0.3, 3, 1.0), "none": np.full((3, 4), np.nan)}
    df = cells(spark, grids)
    got = arrays(hydro.fill_depressions(df, side=side))
    for k, z in grids.items():
        np.testing.assert_array_equal(got[k], filled_by_force(z))
    got = arrays(hydro.fill_depressions(df, True, side=side))
    for k, z in grids.items():
        if k != "none":
            digits = len(str(int(np.nanmax(z) - np.nanmin(z))))
            np.testing.assert_allclose(got[k], filled_by_force(z, 10.0 ** (digits - 8)), atol=1e-9)
    d8, fd8 = arrays(flow.d8_accumulation(df, 1, 1, side=side)), arrays(flow.fd8_accumulation(df, side=side))
    for k, z in grids.items():
        one, many = np.where(np.isnan(z), np.nan, 1.0), np.where(np.isnan(z), np.nan, 1.0)
        for r, c in sorted(((r, c) for (r, c), v in np.ndenumerate(z) if not np.isnan(v)), key=lambda x: -z[x]):
            falls = [(z[r, c] - z[r + dy, c + dx], r + dy, c + dx, math.hypot(dx, dy)) for dx, dy in zip(DX, DY, strict=True) if 0 <= r + dy < z.shape[0] and 0 <= c + dx < z.shape[1] and z[r + dy, c + dx] < z[r, c]]
            if falls:
                _, rr, cc, _ = max(falls, key=lambda f: f[0] / f[3])
                one[rr, cc] += one[r, c]
                total = sum(f[0] ** 2 for f in falls)
                for f, rr, cc, _ in falls:
                    many[rr, cc] += many[r, c] * f**2 / total
        np.testing.assert_array_equal(d8[k], one)
        np.testing.assert_allclose(fd8[k], many, rtol=1e-9)
    inflow = arrays(flow.fd8_inflow_count(df).withColumnRenamed("n", "z"))
    for k, z in grids.items():
        np.testing.assert_array_equal(inflow[k], np.where(np.isnan(z), np.nan, (around(z) > z).sum(0)))


def test_tiles_of_an_empty_table(spark):
    df = cells(spark, {"a": rough(1, 3, 3)}).limit(0)
    for got in (hydro.fill_depressions(df), hydro.fill_depressions(df, True), flow.d8_accumulation(df, 1, 1), flow.fd8_accumulation(df, True)):
        assert got.count() == 0


def pits(z):
    return ~np.isnan(z) & ~np.isnan(around(z)).any(0) & (np.nanmin(np.where(np.isnan(around(z)), np.inf, around(z)), 0) >= z)


def breached_by_force(z, mode="complete", depth=math.inf, length=1 << 31, streams=None):
    """The same rules over dicts: flood from the edges, and from each pit reached walk back, carving."""
    small = 10 ** (len(str(int(np.nanmax(z) - np.nanmin(z)))) - (4 if streams is None else 8))
    cell = {p: v for p, v in np.ndenumerate(z) if not np.isnan(v)}
    next_to = {p: [(p[0] + dy, p[1] + dx) for dx, dy in zip(DX, DY, strict=True)] for p in cell}
    edge = [p for p in cell if any(q not in cell for q in next_to[p])]
    counts = lambda p, q: streams is None or streams[p] <= 0 or streams[q] > 0
    hollow = {p for p in cell if not any(cell[q] < cell[p] and counts(p, q) for q in next_to[p] if q in cell)}
    now = dict(cell)
    for p in hollow:
        if beside := [cell[q] for q in next_to[p] if q in cell and cell[q] >= cell[p]]:
            now[p] = min(beside) - small
    start, back = dict(now), {p: None for p in edge}
    late = {p: 0 if streams is None else int(streams[p] <= 0) for p in cell}
    queue = [(late[p], cell[p], k, p) for k, p in enumerate(edge)]
    n = len(queue)
    while queue:
        queue.sort()
        *_, p = queue.pop(0)
        for q in next_to[p]:
            if q not in cell or q in back:
                continue
            back[q] = p
            if q in hollow and q not in edge:
                trench, level, c = [], now[q], q
                while back[c] is not None:
                    level -= small
                    if streams is not None and streams[c] > 0:
                        dry = [now[x] for x in next_to[c] if x in cell and streams[x] <= 0]
                        level = min(dry) - small if dry and min(dry) < level else level
                    c = back[c]
                    if now[c] <= level:
                        break
                    trench.append((c, level))
                deepest = max((cell[c] - v for c, v in trench), default=0)
                if mode == "complete" or (len(trench) <= length and deepest <= depth):
                    now.update(trench)
                elif mode == "constrained":
                    for c, v in trench[:length]:
                        now[c] = min(now[c], max(v, cell[c] - depth))
            n += 1
            queue.append((late[q], now[q] if streams is not None else start[q], n, q))
    out = z.copy()
    for p, v in now.items():
        out[p] = v
    return out


@pytest.mark.parametrize("mode,depth,length", [("complete", math.inf, 1 << 31), ("selective", 8.0, 3), ("constrained", 8.0, 3), ("constrained", 2.0, 50)])
def test_breaching(spark, mode, depth, length):
    grids = {"a": rough(4, 14, 12), "b": rough(5, 9, 16, 0.0, 30)}
    df = cells(spark, grids)
    got = arrays(hydro.breach_depressions(df, mode, depth, length))
    for k, z in grids.items():
        np.testing.assert_allclose(got[k], breached_by_force(z, mode, depth, length), atol=1e-9)
        assert mode != "complete" or not pits(got[k]).any()
    then = arrays(hydro.breach_depressions(df, mode, depth, length, then_fill=True))
    for k in grids:
        np.testing.assert_allclose(then[k], filled_by_force(got[k]), atol=1e-9)


def test_breach_streams(spark):
    """Streams are reached first, and run below what lies dry beside them."""
    grids = {"a": rough(6, 14, 12, 0.03), "b": rough(7, 12, 12, 0.0)}
    streams = {k: (np.random.default_rng(8).random(z.shape) < 0.15).astype(float) for k, z in grids.items()}
    got = arrays(hydro.breach_streams(cells(spark, grids), cells(spark, streams)))
    for k, z in grids.items():
        np.testing.assert_allclose(got[k], breached_by_force(z, streams=streams[k]), atol=1e-9)
        assert not np.array_equal(got[k], z, equal_nan=True)


def test_breaching_takes_few_bytes_a_cell(monkeypatch):
    """The flood of a grid that can't be parted: some 50 bytes a cell, and more only for blocks of cells."""
    monkeypatch.setattr(hydro, "BLOCK", 1 << 10)
    z = rough(13, 800, 64, 0.0, 4000)
    row, col = np.indices(z.shape).reshape(2, -1)
    tracemalloc.start()
    try:
        g = hydro.Grid(row, col, z.ravel())
        stream = np.zeros(len(g.z), bool)
        stream[g.places(row, col)[col == 32]] = True
        hydro.breach_kernel(g, 1e-4, stream=stream)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * z.size


def test_breaching_in_batches(spark):
    """Grids that share a task, in batches that end within them; streams without a value are dry."""
    grids = {k: rough(20 + i, 9, 11, 0.05 * i) for i, k in enumerate("abcdef")}
    streams = {k: np.where(np.random.default_rng(i).random(z.shape) < 0.3, 1.0, np.nan) for i, (k, z) in enumerate(grids.items())}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        df = cells(spark, grids)
        got, limited = arrays(hydro.breach_streams(df, cells(spark, streams))), arrays(hydro.breach_depressions(df, "constrained", 9.0, 3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, z in grids.items():
        np.testing.assert_allclose(got[k], breached_by_force(z, streams=np.nan_to_num(streams[k])), atol=1e-9)
        np.testing.assert_allclose(limited[k], breached_by_force(z, "constrained", 9.0, 3), atol=1e-9)


def test_breaching_in_windows(spark):
    """Cells that a window is sure of are those of the whole flood, in ties too; grids with others are flooded whole."""
    shapes = [(50, 9, 0.0, 1000, 0), (40, 8, 0.2, 3, 0), (50, 9, 0.05, 40, 0), (30, 30, 0.0, 8, 0.3), (6, 5, 0.0, 8, 0)]
    grids = {str(i): rough(30 + i, rows, cols, holes, levels, tilt) for i, (rows, cols, holes, levels, tilt) in enumerate(shapes)}
    want = {k: breached_by_force(z) for k, z in grids.items()}
    df = cells(spark, grids)
    got = hydro._windows(df, (10, 20), 6).toPandas()
    assert len(got) == sum(z.size for z in grids.values())
    whole = got.groupby("raster_id")["sure"].all()
    assert whole.any() and not whole.all() and whole["4"]
    for k, p in got[got["sure"]].groupby("raster_id"):
        np.testing.assert_allclose(p["z"].astype(float), want[k][p["row"], p["col"]], atol=1e-9)
    for k, z in arrays(hydro.breach_depressions(df, window=(10, 20), halo=6)).items():
        np.testing.assert_allclose(z, want[k], atol=1e-9)


@pytest.mark.parametrize("radius,bins", [(1, 3), (4, 40), (9, 2)])
def test_percentile_tiles(spark, radius, bins):
    """Small tiles, boxes wider than a tile, many groups: the counts of a plain loop."""
    grids = {"a": rough(9, 21, 13), "b": rough(10, 6, 25, 0.4, 5)}
    df = cells(spark, grids)
    tagged = stats.fine_bin(df)
    groups = {(r["raster_id"], r["row"], r["col"]): (r["bin"], r["prob"]) for r in tagged.join(stats.regrouped(tagged, bins), ["raster_id", "fine"]).collect()}
    got = arrays(focal.elevation_percentile(df, radius, bins, side=4))
    for k, z in grids.items():
        for (r, c), v in np.ndenumerate(z):
            box = [groups[k, i, j][0] for i in range(max(1, r - radius), r + radius + 1) for j in range(max(1, c - radius), c + radius + 1) if (k, i, j) in groups]
            if np.isnan(v) or not box:
                assert np.isnan(got[k][r, c])
            else:
                g, prob = groups[k, r, c]
                assert got[k][r, c] == pytest.approx(100 * (sum(b < g for b in box) + prob * box.count(g)) / len(box))


def test_boxes_of_any_radius(spark):
    z = rough(11, 15, 18)
    df = cells(spark, {"a": z})
    for rx, ry in ((1, 1), (2, 0), (30, 3)):
        got = arrays(focal.mean_filter(df, 2 * rx + 1, 2 * ry + 1))["a"]
        want = [[np.nan if np.isnan(v) else np.nanmean(z[max(0, r - ry) : r + ry + 1, max(0, c - rx) : c + rx + 1]) for c, v in enumerate(line)] for r, line in enumerate(z)]
        np.testing.assert_allclose(got, want)


def test_many_grids_are_not_broadcast(spark, monkeypatch):
    from ridgeline.operators import grid as grids

    df = cells(spark, {k: rough(12, 4, 5) for k in "abcd"})
    want = arrays(focal.deviation_from_mean(df, 1))
    monkeypatch.setattr(grids, "BROADCAST_ROWS", 2)
    got = focal.deviation_from_mean(df, 1)
    for k, z in arrays(got).items():
        np.testing.assert_allclose(z, want[k])
