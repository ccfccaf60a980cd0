"""LAS point clouds: header and core point records."""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterable

import numpy as np

from .errors import HeaderError, UnsupportedFormat

# name, struct letters (fixed values of the format, versions 1.0 to 1.3)
HEADER = (
    ("signature", "4s"), ("file_source_id", "H"), ("global_encoding", "H"), ("guid", "16s"), ("version_major", "B"), ("version_minor", "B"),
    ("system_id", "32s"), ("software", "32s"), ("day", "H"), ("year", "H"), ("header_size", "H"), ("point_offset", "I"), ("n_vlrs", "I"),
    ("point_format", "B"), ("record_length", "H"), ("n_points", "I"), ("points_by_return", "5I"), ("x_scale", "d"), ("y_scale", "d"), ("z_scale", "d"),
    ("x_offset", "d"), ("y_offset", "d"), ("z_offset", "d"), ("max_x", "d"), ("min_x", "d"), ("max_y", "d"), ("min_y", "d"), ("max_z", "d"), ("min_z", "d"),
)
CORE = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")])


def header(path: str) -> dict:
    with open(path, "rb") as f:
        raw = f.read(375)
    if raw[:4] != b"LASF":
        raise HeaderError(f"{path} is no LAS file")
    at, h = 0, {}
    for name, kind in HEADER:
        v = struct.unpack_from("<" + kind, raw, at)
        at += struct.calcsize("<" + kind)
        h[name] = list(v) if len(v) > 1 else v[0].rstrip(b"\0").decode("latin-1") if kind.endswith("s") and name != "guid" else v[0].hex() if name == "guid" else v[0]
    if h["version_major"] != 1:
        raise UnsupportedFormat(f"{path}: version {h['version_major']}.{h['version_minor']}")
    if h["version_minor"] >= 4 and len(raw) >= 375:
        n, *by = struct.unpack_from("<Q15Q", raw, 247)
        h["n_points"] = h["n_points"] or n
        h["points_by_return"] = by[:7]
    return h


def created(day: int, year: int) -> datetime.date | None:
    """The date of a day of the year, counted from 1."""
    return datetime.date(year, 1, 1) + datetime.timedelta(days=day - 1) if year and day else None


def records(path: str, h: dict, first: int, end: int) -> np.ndarray:
    """Core records ``first`` to ``end``; what follows the core in a record is passed over."""
    wide = np.dtype({"names": CORE.names, "formats": [CORE[n] for n in CORE.names], "offsets": [CORE.fields[n][1] for n in CORE.names], "itemsize": h["record_length"]})
    return np.fromfile(path, wide, end - first, offset=h["point_offset"] + first * h["record_length"])


def write(path: str, points: np.ndarray, scale=(0.01, 0.01, 0.01), offset=(0.0, 0.0, 0.0), day: int = 1, year: int = 2020) -> None:
    """A version 1.2 file of point format 0 from raw core records."""
    write_parts(path, [points], scale, offset, day, year)


def write_parts(path: str, parts: Iterable[np.ndarray], scale=(0.01, 0.01, 0.01), offset=(0.0, 0.0, 0.0), day: int = 1, year: int = 2020) -> int:
    """The same from parts, one after another: only one is held, and the header follows the last.  Gives the number of points."""
    n, by, ends = 0, [0] * 5, {}
    with open(path, "wb") as f:
        f.seek(227)
        for points in parts:
            n += len(points)
            by = [b + int(((points["flags"] & 7) == k).sum()) for k, b in enumerate(by, 1)]
            for a, s, o in zip("xyz", scale, offset, strict=True) if len(points) else ():
                v = points[a] * s + o
                most, least = ends.get(a, (-np.inf, np.inf))
                ends[a] = max(most, v.max()), min(least, v.min())
            f.write(points.astype(CORE).tobytes())
        values = {
            "signature": b"LASF", "file_source_id": 0, "global_encoding": 0, "guid": b"", "version_major": 1, "version_minor": 2, "system_id": b"", "software": b"ridgeline",
            "day": day, "year": year, "header_size": 227, "point_offset": 227, "n_vlrs": 0, "point_format": 0, "record_length": 20, "n_points": n,
        }
        f.seek(0)
        for name, kind in HEADER[:16]:
            f.write(struct.pack("<" + kind, values[name]))
        f.write(struct.pack("<5I", *by))
        f.write(struct.pack("<6d", *scale, *offset))
        for a in "xyz":
            f.write(struct.pack("<2d", *ends.get(a, (0.0, 0.0))))
        f.truncate(227 + n * CORE.itemsize)  # without points the header is all there is
    return n
