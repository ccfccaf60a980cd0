"""Codecs of grid formats.

``header(path)`` and ``rows(path, header, first, end, span)`` read; ``head(header,
least, most)`` and ``encode(header, values)`` make the bytes of a header and of a
block of rows.  A header is a dict with the fields of the metadata table.  Values
are float64 arrays in which NaN stands for no-data.  Formats with ``ROW_BYTES``
have rows at fixed places, so blocks are read and written in parallel; for text
``spans`` finds the bytes of each block in one light pass.
"""

from __future__ import annotations

import os

import numpy as np

from . import geotiff
from .errors import AmbiguousFormat, DataError, HeaderError, UnsupportedFormat

NODATA = -32768.0
EMPTY = {
    "rows": 0, "cols": 0, "north": 0.0, "south": 0.0, "east": 0.0, "west": 0.0, "nodata": NODATA, "data_type": "FLOAT32", "epsg": None, "crs_wkt": "",
    "z_units": "", "xy_units": "", "palette": "", "palette_nonlinearity": 1.0, "display_min": None, "display_max": None, "n_bands": 1, "photometric": None,
    "byte_order": "LITTLE_ENDIAN", "pixel_is_area": True, "reflect_at_boundaries": False, "metadata": [],
}

# format name, extensions (the first is written) (fixed values)
EXTENSIONS = {
    "arcgis_binary": (".flt", ".hdr"), "arcgis_ascii": (".asc", ".txt"), "grass_ascii": (".txt",), "whitebox": (".dep", ".tas"), "idrisi": (".rst", ".rdc"),
    "geotiff": (".tif", ".tiff"), "surfer": (".grd",), "saga": (".sdat", ".sgrd"),
}


def detect(path: str) -> str:
    """The format by extension; two formats share .txt, whose first lines tell."""
    ext = os.path.splitext(path)[1].lower()
    found = [f for f, e in EXTENSIONS.items() if ext in e]
    if not found:
        raise UnsupportedFormat(f"no grid format has the extension {ext!r}")
    if len(found) == 1:
        return found[0]
    if not os.path.exists(path):
        raise AmbiguousFormat(f"{path}: any of {', '.join(found)}")
    with open(path) as f:
        head = {line.split()[0].rstrip(":").lower() for line, _ in zip(f, range(6), strict=False) if line.strip()}
    if "ncols" in head:
        return "arcgis_ascii"
    if "north" in head or "cols" in head:
        return "grass_ascii"
    raise AmbiguousFormat(f"{path}: any of {', '.join(found)}")


def is_supported(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in {e for x in EXTENSIONS.values() for e in x}


def sibling(path: str, ext: str) -> str:
    return os.path.splitext(path)[0] + ext


def spelled(v: float) -> str:
    """The shortest text that reads back as the number."""
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(float(v))


def blanked(z: np.ndarray, nodata: float) -> np.ndarray:
    z = z.astype(np.float64)
    z[z == nodata] = np.nan
    return z


def stored(z: np.ndarray, nodata: float) -> np.ndarray:
    return np.where(np.isnan(z), nodata, z)


def as_kept(nodata: float, kind: np.dtype) -> float:
    """No-data as cells of a type hold it: floats round it."""
    return float(kind.type(nodata)) if kind.kind == "f" else nodata


def spans(path: str, skip: int, h: dict, step: int, chunk: int = 1 << 24) -> list[tuple[int, int]]:
    """(start, end) in bytes of every ``step`` rows of white-space separated values behind ``skip`` lines; values may break lines anywhere."""
    out, seen, inside, want = [], 0, False, step * h["cols"]
    with open(path, "rb") as f:
        for _ in range(skip):
            f.readline()
        start = at = f.tell()
        while block := f.read(chunk):
            word = np.frombuffer(block, np.uint8) > 32
            first = word.copy()
            first[1:] &= ~word[:-1]
            first[0] &= not inside
            places = np.flatnonzero(first)
            k = want * (len(out) + 1) - seen  # the word that begins the next block
            while k < len(places):
                out.append((start, at + int(places[k])))
                start = at + int(places[k])
                k += want
            seen, inside, at = seen + len(places), bool(word[-1]), at + len(block)
    if seen < h["rows"] * h["cols"]:
        raise DataError(f"{path}: {seen} values")
    out.append((start, at))
    return out[: -(-h["rows"] // step)]


def words(path: str, h: dict, span: tuple[int, int] | None, first: int, end: int) -> list[bytes]:
    """The values of rows first to end - 1 as text, from a span of the file that begins with row first."""
    a, z = span or spans(path, h["_skip"], h, end)[0]
    with open(path, "rb") as f:
        f.seek(a)
        got = f.read(z - a).split()
    return got[(0 if span else first * h["cols"]) : (end - (first if span else 0)) * h["cols"]]


def lines(h: dict, z: np.ndarray) -> bytes:
    return "".join([" ".join(map(spelled, row)) + "\n" for row in stored(z, h["nodata"]).tolist()]).encode()


# ---- the two ESRI formats ----


def _esri_extent(h: dict, k: dict[str, str]) -> None:
    try:
        cell, h["rows"], h["cols"] = float(k["cellsize"]), int(k["nrows"]), int(k["ncols"])
    except KeyError as e:
        raise HeaderError(f"the header has no {e}") from None
    x = float(k["xllcorner"]) if "xllcorner" in k else float(k.get("xllcenter", 0)) - cell / 2
    y = float(k["yllcorner"]) if "yllcorner" in k else float(k.get("yllcenter", 0)) - cell / 2
    h |= {"west": x, "south": y, "east": x + cell * h["cols"], "north": y + cell * h["rows"], "nodata": float(k.get("nodata_value", NODATA))}


def _esri_lines(h: dict) -> list[str]:
    cell = (h["east"] - h["west"]) / h["cols"]
    return [
        f"NCOLS {h['cols']}", f"NROWS {h['rows']}", f"XLLCORNER {spelled(h['west'])}", f"YLLCORNER {spelled(h['south'])}", f"CELLSIZE {spelled(cell)}",
        f"NODATA_VALUE {spelled(h['nodata'])}",
    ]


class ArcAscii:
    TEXT = True

    @staticmethod
    def header(path: str) -> dict:
        h, k = dict(EMPTY), {}
        with open(path) as f:
            for n, line in enumerate(f):
                w = line.split()
                if len(w) != 2 or not w[0][0].isalpha():
                    break
                k[w[0].lower()] = w[1]
                h["_skip"] = n + 1
        _esri_extent(h, k)
        return h

    @staticmethod
    def rows(path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        z = np.array(words(path, h, span, first, end), np.float64)
        return blanked(z.reshape(-1, h["cols"]), h["nodata"])

    @staticmethod
    def head(h: dict, least: float, most: float) -> bytes:
        return ("\n".join(_esri_lines(h)) + "\n").encode()

    encode = staticmethod(lines)


class ArcBinary:
    DATA, HEAD = ".flt", ".hdr"

    @staticmethod
    def row_bytes(h: dict) -> int:
        return 4 * h["cols"]

    @staticmethod
    def header(path: str) -> dict:
        h = dict(EMPTY)
        with open(sibling(path, ".hdr")) as f:
            k = {w[0].lower(): w[1] for w in (line.split() for line in f) if len(w) >= 2}
        _esri_extent(h, k)
        h["byte_order"] = "BIG_ENDIAN" if k.get("byteorder", "lsbfirst").lower().startswith("msb") else "LITTLE_ENDIAN"
        return h

    @staticmethod
    def rows(path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        kind = np.dtype(">f4" if h["byte_order"] == "BIG_ENDIAN" else "<f4")
        z = np.fromfile(sibling(path, ".flt"), kind, (end - first) * h["cols"], offset=first * h["cols"] * 4)
        if len(z) != (end - first) * h["cols"]:
            raise DataError(f"{path} is too short")
        return blanked(z.reshape(-1, h["cols"]), as_kept(h["nodata"], kind))

    @staticmethod
    def head(h: dict, least: float, most: float) -> bytes:
        return ("\n".join([*_esri_lines(h), f"BYTEORDER {'MSBFIRST' if h['byte_order'] == 'BIG_ENDIAN' else 'LSBFIRST'}"]) + "\n").encode()

    @staticmethod
    def encode(h: dict, z: np.ndarray) -> bytes:
        return stored(z, h["nodata"]).astype(">f4" if h["byte_order"] == "BIG_ENDIAN" else "<f4").tobytes()


# ---- GRASS ----


class GrassAscii:
    TEXT = True
    KEYS = ("north", "south", "east", "west", "rows", "cols", "null", "nodata", "type", "multiplier")

    @classmethod
    def header(cls, path: str) -> dict:
        h, k = dict(EMPTY), {}
        with open(path) as f:
            for n, line in enumerate(f):
                w = line.replace(":", " ").split()
                if len(w) != 2 or w[0].lower() not in cls.KEYS:  # data may also have few values
                    break
                k[w[0].lower()] = w[1]
                h["_skip"] = n + 1
        try:
            h |= {e: float(k[e]) for e in ("north", "south", "east", "west")} | {"rows": int(k["rows"]), "cols": int(k["cols"])}
        except KeyError as e:
            raise HeaderError(f"the header has no {e}") from None
        null = k.get("nodata", k.get("null", "*"))
        h["nodata"] = NODATA if null == "*" else float(null)
        return h

    @staticmethod
    def rows(path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        z = np.array([np.nan if w == b"*" else float(w) for w in words(path, h, span, first, end)])
        return blanked(z.reshape(-1, h["cols"]), h["nodata"])

    @staticmethod
    def head(h: dict, least: float, most: float) -> bytes:
        ends = "".join(f"{e}: {spelled(h[e])}\n" for e in ("north", "south", "east", "west"))
        return f"{ends}rows: {h['rows']}\ncols: {h['cols']}\nnodata: {spelled(h['nodata'])}\n".encode()

    encode = staticmethod(lines)


# ---- header and payload in two files ----


def _order(h: dict) -> str:
    return ">" if h["byte_order"] == "BIG_ENDIAN" else "<"


class Whitebox:
    DATA, HEAD = ".tas", ".dep"
    KINDS = {"double": "f8", "float": "f4", "integer": "i2", "byte": "u1"}
    TYPES = {"double": "FLOAT64", "float": "FLOAT32", "integer": "INT16", "byte": "UINT8"}

    @classmethod
    def header(cls, path: str) -> dict:
        h, notes = dict(EMPTY), []
        with open(sibling(path, ".dep")) as f:
            for line in f:
                k, _, v = line.partition(":")
                k, v = k.strip().lower(), v.strip()
                if k in ("north", "south", "east", "west"):
                    h[k] = float(v)
                elif k in ("rows", "cols"):
                    h[k] = int(v)
                elif k == "data type":
                    h["_kind"] = v.lower()
                elif k == "byte order":
                    h["byte_order"] = "BIG_ENDIAN" if "big" in v.lower() else "LITTLE_ENDIAN"
                elif k == "nodata":
                    h["nodata"] = float(v)
                elif k == "metadata entry":
                    notes.append(v)
                elif name := {"z units": "z_units", "xy units": "xy_units", "projection": "crs_wkt", "preferred palette": "palette"}.get(k):
                    h[name] = v
                elif name := {"display min": "display_min", "display max": "display_max", "palette nonlinearity": "palette_nonlinearity"}.get(k):
                    h[name] = float(v)
        if h.get("_kind") not in cls.KINDS:
            raise HeaderError(f"{path}: data type {h.get('_kind')!r}")
        return h | {"data_type": cls.TYPES[h["_kind"]], "metadata": notes}

    @classmethod
    def rows(cls, path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        kind = np.dtype(_order(h) + cls.KINDS[h["_kind"]])
        z = np.fromfile(sibling(path, ".tas"), kind, (end - first) * h["cols"], offset=first * h["cols"] * kind.itemsize)
        if len(z) != (end - first) * h["cols"]:
            raise DataError(f"{path} is too short")
        return blanked(z.reshape(-1, h["cols"]), as_kept(h["nodata"], kind))

    @classmethod
    def _written(cls, h: dict) -> tuple[dict, str]:
        kind = {"FLOAT64": "double", "INT8": "integer", "INT16": "integer", "UINT8": "byte"}.get(h["data_type"], "float")
        return (h | {"nodata": 255.0} if kind == "byte" and not 0 <= h["nodata"] <= 255 else h), kind

    @classmethod
    def row_bytes(cls, h: dict) -> int:
        return h["cols"] * np.dtype(cls.KINDS[cls._written(h)[1]]).itemsize

    @classmethod
    def encode(cls, h: dict, z: np.ndarray) -> bytes:
        h, kind = cls._written(h)
        return stored(z, h["nodata"]).astype(_order(h) + cls.KINDS[kind]).tobytes()

    @classmethod
    def head(cls, h: dict, lo: float, hi: float) -> bytes:
        h, kind = cls._written(h)
        lines = {
            "Min": lo, "Max": hi, "North": h["north"], "South": h["south"], "East": h["east"], "West": h["west"], "Cols": h["cols"], "Rows": h["rows"], "Stacks": h["n_bands"],
            "Data Type": kind.upper(), "Z Units": h["z_units"] or "not specified", "XY Units": h["xy_units"] or "not specified",
            "Projection": h["crs_wkt"] or "not specified", "Data Scale": "continuous", "Display Min": lo if h["display_min"] is None else h["display_min"],
            "Display Max": hi if h["display_max"] is None else h["display_max"], "Preferred Palette": h["palette"] or "grey.pal", "NoData": spelled(h["nodata"]),
            "Byte Order": h["byte_order"], "Palette Nonlinearity": h["palette_nonlinearity"],
        }
        notes = [f"Metadata Entry:\t{m.replace(':', ';')}\n" for m in h["metadata"]]
        return "".join([*[f"{k}:\t{v}\n" for k, v in lines.items()], *notes]).encode()


class Idrisi:
    DATA, HEAD = ".rst", ".rdc"
    KINDS = {"real": "<f4", "integer": "<i2", "byte": "u1"}

    @classmethod
    def header(cls, path: str) -> dict:
        h, notes = dict(EMPTY), []
        with open(sibling(path, ".rdc")) as f:
            for line in f:
                k, _, v = line.partition(":")
                k, v = k.strip().lower(), v.strip()
                if k in ("columns", "rows"):
                    h["cols" if k == "columns" else "rows"] = int(v)
                elif k in ("min. x", "max. x", "min. y", "max. y"):
                    h[{"min. x": "west", "max. x": "east", "min. y": "south", "max. y": "north"}[k]] = float(v)
                elif k == "data type":
                    h["_kind"] = v.lower()
                elif k == "file type" and v.lower() != "binary":
                    raise UnsupportedFormat(f"{path}: file type {v}")
                elif k == "flag value" and v.lower() not in ("none", ""):
                    h["nodata"] = float(v)
                elif k in ("comment", "lineage", "title") and v:
                    notes.append(v)
                elif k == "value units":
                    h["z_units"] = v
                elif k == "ref. units":
                    h["xy_units"] = v
                elif k in ("display min", "display max"):
                    h[k.replace(" ", "_")] = float(v)
        if h.get("_kind") not in cls.KINDS:
            raise UnsupportedFormat(f"{path}: data type {h.get('_kind')!r}")
        return h | {"data_type": {"real": "FLOAT32", "integer": "INT16", "byte": "UINT8"}[h["_kind"]], "metadata": notes}

    @classmethod
    def rows(cls, path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        kind = np.dtype(cls.KINDS[h["_kind"]])
        z = np.fromfile(sibling(path, ".rst"), kind, (end - first) * h["cols"], offset=first * h["cols"] * kind.itemsize)
        if len(z) != (end - first) * h["cols"]:
            raise DataError(f"{path} is too short")
        return blanked(z.reshape(-1, h["cols"]), as_kept(h["nodata"], kind))

    @staticmethod
    def _written(h: dict) -> str:
        return {"INT8": "integer", "INT16": "integer", "UINT8": "byte"}.get(h["data_type"], "real")

    @classmethod
    def row_bytes(cls, h: dict) -> int:
        return h["cols"] * np.dtype(cls.KINDS[cls._written(h)]).itemsize

    @classmethod
    def encode(cls, h: dict, z: np.ndarray) -> bytes:
        return stored(z, h["nodata"]).astype(cls.KINDS[cls._written(h)]).tobytes()

    @classmethod
    def head(cls, h: dict, lo: float, hi: float) -> bytes:
        kind = cls._written(h)
        shown = [lo if h["display_min"] is None else h["display_min"], hi if h["display_max"] is None else h["display_max"]]
        lines = [
            ("file format", "IDRISI Raster A.1"), ("file title", ""), ("data type", kind), ("file type", "binary"), ("columns", h["cols"]), ("rows", h["rows"]),
            ("ref. system", "plane"), ("ref. units", h["xy_units"] or "m"), ("unit dist.", "1.0"), ("min. X", h["west"]), ("max. X", h["east"]),
            ("min. Y", h["south"]), ("max. Y", h["north"]), ("pos'n error", "unspecified"), ("resolution", (h["east"] - h["west"]) / h["cols"]),
            ("min. value", lo), ("max. value", hi), ("display min", shown[0]), ("display max", shown[1]), ("value units", h["z_units"] or "unspecified"),
            ("value error", "unspecified"), ("flag value", spelled(h["nodata"])), ("flag def'n", "missing data"), ("legend cats", 0),
            *[("comment", m) for m in h["metadata"]],
        ]
        return "".join([f"{k:<12}: {v}\n" for k, v in lines]).encode()


class GeoTiff:
    @staticmethod
    def header(path: str) -> dict:
        return EMPTY | geotiff.header(path)

    @staticmethod
    def rows(path: str, h: dict, first: int, end: int, span=None) -> np.ndarray:
        kind = np.dtype("f4" if h["data_type"] == "FLOAT32" else "f8")
        return blanked(geotiff.rows(path, first, end), as_kept(h["nodata"], kind))

    @staticmethod
    def row_bytes(h: dict) -> int:
        return geotiff.row_bytes(h)

    @staticmethod
    def head(h: dict, least: float, most: float) -> bytes:
        return geotiff.head(h)

    @staticmethod
    def encode(h: dict, z: np.ndarray) -> bytes:
        return geotiff.encode(h, stored(z, h["nodata"]))


CODECS = {"arcgis_ascii": ArcAscii, "arcgis_binary": ArcBinary, "grass_ascii": GrassAscii, "whitebox": Whitebox, "idrisi": Idrisi, "geotiff": GeoTiff}


def codec(path: str, name: str | None = None):
    name = name or detect(path)
    if name not in CODECS:
        raise UnsupportedFormat(f"{name} can be neither read nor written")
    return name, CODECS[name]


def is_text(c) -> bool:
    return getattr(c, "TEXT", False)


def files(path: str, c) -> tuple[str, str]:
    """Where a format keeps values and where its header; the same file where it has one."""
    return (sibling(path, c.DATA), sibling(path, c.HEAD)) if hasattr(c, "DATA") else (path, path)


def remove(path: str, c) -> None:
    for f in set(files(path, c)):
        if os.path.exists(f):
            os.remove(f)


def ends(z: np.ndarray) -> tuple[float, float]:
    """Least and greatest value; (0, 0) where there is none."""
    good = z[np.isfinite(z)]
    return (float(good.min()), float(good.max())) if len(good) else (0.0, 0.0)


def write(path: str, c, h: dict, z: np.ndarray) -> None:
    """A whole grid at once."""
    data, head = files(path, c)
    with open(head, "wb") as f:
        f.write(c.head(h, *ends(z)))
        if head == data:
            f.write(c.encode(h, z))
    if head != data:
        with open(data, "wb") as f:
            f.write(c.encode(h, z))
