"""GeoTIFF: strips or tiles; uncompressed, PackBits, LZW or Deflate; written from the TIFF 6.0 specification."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .codes import keyword
from .errors import DataError, HeaderError, UnsupportedFormat

# code: (struct letter, bytes) (fixed values of the format)
FIELD = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
FIELD_NAMES = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE"}
TAG_NAMES = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation",
    270: "ImageDescription", 273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution",
    283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 317: "Predictor", 320: "ColorMap",
    322: "TileWidth", 323: "TileLength", 324: "TileOffsets", 325: "TileByteCounts", 338: "ExtraSamples", 339: "SampleFormat", 33550: "ModelPixelScaleTag",
    33922: "ModelTiepointTag", 34264: "ModelTransformationTag", 34735: "GeoKeyDirectoryTag", 34736: "GeoDoubleParamsTag", 34737: "GeoAsciiParamsTag",
    42112: "GDAL_METADATA", 42113: "GDAL_NODATA",
}
KEY_NAMES = {
    1024: "GTModelTypeGeoKey", 1025: "GTRasterTypeGeoKey", 1026: "GTCitationGeoKey", 2048: "GeographicTypeGeoKey", 2049: "GeogCitationGeoKey",
    2050: "GeogGeodeticDatumGeoKey", 2051: "GeogPrimeMeridianGeoKey", 2052: "GeogLinearUnitsGeoKey", 2054: "GeogAngularUnitsGeoKey", 2056: "GeogEllipsoidGeoKey",
    3072: "ProjectedCSTypeGeoKey", 3073: "PCSCitationGeoKey", 3074: "ProjectionGeoKey", 3075: "ProjCoordTransGeoKey", 3076: "ProjLinearUnitsGeoKey",
    4096: "VerticalCSTypeGeoKey", 4099: "VerticalUnitsGeoKey",
}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8", (3, 32): "f4", (3, 64): "f8"}
TYPES = {"u1": "UINT8", "u2": "UINT16", "u4": "UINT32", "u8": "UINT64", "i1": "INT8", "i2": "INT16", "i4": "INT32", "i8": "INT64", "f4": "FLOAT32", "f8": "FLOAT64"}


def directory(path: str) -> tuple[str, dict[int, tuple[int, int, list]]]:
    """Byte order, and for each tag of the first image its field type, count and values."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 8:
            raise HeaderError(f"{path} is no TIFF file")
        version, at = struct.unpack(order + "HI", head[2:])
        if version != 42:
            raise UnsupportedFormat(f"{path}: TIFF version {version}")
        f.seek(at)
        (n,) = struct.unpack(order + "H", f.read(2))
        entries = f.read(12 * n)
        tags = {}
        for k in range(n):
            code, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
            if kind not in FIELD:
                continue
            letter, size = FIELD[kind]
            raw = entries[12 * k + 8 : 12 * k + 12]
            if size * count > 4:
                f.seek(struct.unpack(order + "I", raw)[0])
                raw = f.read(size * count)
            raw = raw[: size * count]
            if kind == 2:
                values = [raw.split(b"\0")[0].decode("latin-1")]
            elif len(letter) == 2:
                pairs = struct.unpack(order + letter * count, raw)
                values = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            else:
                values = list(struct.unpack(order + letter * count, raw))
            tags[code] = (kind, count, values)
    return order, tags


def geokeys(tags: dict) -> dict[int, tuple[str, list]]:
    got = tags.get(34735, (3, 0, []))[2]
    doubles, text = tags.get(34736, (12, 0, []))[2], "".join(tags.get(34737, (2, 0, [""]))[2])
    out = {}
    for k in range(4, len(got) - 3, 4):
        key, where, count, value = got[k : k + 4]
        if where == 34736:
            out[key] = ("DOUBLE", doubles[value : value + count])
        elif where == 34737:
            out[key] = ("ASCII", [text[value : value + count].rstrip("|")])
        else:
            out[key] = ("SHORT", [value])
    return out


def header(path: str) -> dict:
    order, tags = directory(path)
    one = lambda code, default=None: tags[code][2][0] if code in tags else default
    cols, rows = one(256), one(257)
    keys = geokeys(tags)
    if 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][2][:2]
        i, j, _, x, y = tags[33922][2][:5]
        west, north = x - i * sx, y + j * sy
    elif 34264 in tags:
        m = tags[34264][2]
        sx, sy, west, north = m[0], -m[5], m[3], m[7]
    else:
        raise HeaderError(f"{path} has no georeference")
    area = keys.get(1025, ("", [1]))[1][0] == 1
    wide, high = (cols, rows) if area else (cols - 1, rows - 1)
    nodata = float(str(one(42113, "")).strip("\0 ") or np.finfo(np.float32).max)
    bits, samples = one(258, 1), one(277, 1)
    kind = {3: "RGB", 4: "RGBA"}.get(samples, "") + (str(bits * samples) if samples > 1 else "")
    photometric = one(262, 1)
    if samples == 1:
        kind = "PALETTED" if photometric == 3 else TYPES.get(KINDS.get((one(339, 1), bits), ""), "UNKNOWN")
    epsg = next((v for k in (3072, 2048) if k in keys and 1024 <= (v := keys[k][1][0]) < 32767), None)
    return {
        "rows": rows, "cols": cols, "west": west, "north": north, "east": west + wide * sx, "south": north - high * sy, "nodata": nodata, "data_type": kind,
        "epsg": epsg, "n_bands": samples, "photometric": photometric, "byte_order": "LITTLE_ENDIAN" if order == "<" else "BIG_ENDIAN", "pixel_is_area": area,
        "crs_wkt": next((keys[k][1][0] for k in (1026, 3073) if k in keys and "projcs[" in str(keys[k][1][0]).lower()), "PROJCS[]" if 3072 in keys else ""), "metadata": [f"{name}: {word or value}" for _, _, name, _, _, value, word in tag_rows(path)],
    }


def tag_rows(path: str) -> list[tuple[str, int, str, str, int, str, str | None]]:
    """(section, code, name, type, count, value, keyword) of every tag and geokey, in order."""
    _, tags = directory(path)
    show = lambda v: ", ".join(map(str, v[:16])) + (" ..." if len(v) > 16 else "")
    image = [("image", c, TAG_NAMES.get(c, f"Unknown {c}"), FIELD_NAMES[k], n, show(v), keyword(c, v[0]) if n == 1 else None) for c, (k, n, v) in sorted(tags.items())]
    return image + [("geokey", c, KEY_NAMES.get(c, f"Unknown {c}"), k, len(v), show(v), keyword(c, v[0]) if len(v) == 1 else None) for c, (k, v) in sorted(geokeys(tags).items())]


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes grow a code early."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table = [bytes([k]) for k in range(256)] + [b"", b""]
                width, last = 9, b""
                continue
            if not table:
                raise DataError("LZW data without a clear code")
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise DataError("a broken LZW code")
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            width = min(12, (len(table) + 1).bit_length() if len(table) >= 511 else 9)
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def rows(path: str, first: int, end: int) -> np.ndarray:
    """Rows of the first image; only the strips or tiles that hold them are read."""
    order, tags = directory(path)
    one = lambda code, default=None: tags[code][2][0] if code in tags else default
    cols, high, samples, bits = one(256), one(257), one(277, 1), one(258, 1)
    kind = KINDS.get((one(339, 1), bits))
    if kind is None or one(284, 1) != 1:
        raise UnsupportedFormat(f"{path}: {bits} bits a sample, sample format {one(339, 1)}, planes {one(284, 1)}")
    compression, predictor = one(259, 1), one(317, 1)
    unpack = {1: lambda b: b, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpackbits}.get(compression)
    if unpack is None:
        raise UnsupportedFormat(f"{path}: compression {compression}")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (cols, min(one(278, high), high))
    at, size = tags[324 if tiled else 273][2], tags[325 if tiled else 279][2]
    across = -(-cols // bw)
    out = np.zeros((end - first, cols, samples), np.dtype(kind))
    dtype = np.dtype(order + kind)
    with open(path, "rb") as f:
        for r in range(first // bh, -(-end // bh)):
            tall = bh if tiled else min(bh, high - r * bh)
            for c in range(across):
                k = r * across + c
                f.seek(at[k])
                raw = unpack(f.read(size[k]))
                if len(raw) < tall * bw * samples * dtype.itemsize:
                    raise DataError(f"{path}: block {k} is too short")
                block = np.frombuffer(raw, dtype, tall * bw * samples).reshape(tall, bw, samples).astype(kind)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=kind)
                elif predictor != 1:
                    raise UnsupportedFormat(f"{path}: predictor {predictor}")
                a, z = max(first, r * bh), min(end, r * bh + tall, high)
                wide = min(bw, cols - c * bw)
                out[a - first : z - first, c * bw : c * bw + wide] = block[a - r * bh : z - r * bh, :wide]
    if samples == 1:
        z = out[:, :, 0]
        if one(262, 1) == 3 and 320 in tags:  # a colour map: all reds, all greens, all blues, of 16 bits
            red, green, blue = (np.array(tags[320][2], np.int64).reshape(3, -1) * 255 // 65535).tolist()
            colours = np.array([0xFF << 24 | r << 16 | g << 8 | b for r, g, b in zip(red, green, blue, strict=True)], np.float64)
            if z.size and z.max() >= len(colours):
                raise DataError(f"{path}: a cell beyond the colour map")
            return colours[z]
        if one(262, 1) == 0 and kind[0] == "u":  # white is zero
            z = np.iinfo(z.dtype).max - z
        return z.astype(np.float64)
    if kind not in ("u1", "u2"):
        raise UnsupportedFormat(f"{path}: colours of {bits} bits")
    c = out.astype(np.int64) >> (8 if kind == "u2" else 0)
    alpha = c[:, :, 3] if samples > 3 else 255
    return (alpha << 24 | c[:, :, 0] << 16 | c[:, :, 1] << 8 | c[:, :, 2]).astype(np.float64)


def _sampled(h: dict) -> tuple[np.dtype, int]:
    """Type and number of samples of a cell as written."""
    order = ">" if h["byte_order"] == "BIG_ENDIAN" else "<"
    if h["data_type"].startswith("RGB"):
        return np.dtype("u1"), 4 if h["data_type"].startswith("RGBA") else 3
    if h["data_type"] == "PALETTED":
        return np.dtype("u1"), 1
    return np.dtype(order + {v: k for k, v in TYPES.items()}.get(h["data_type"], "f4")), 1


def row_bytes(h: dict) -> int:
    kind, n = _sampled(h)
    return h["cols"] * kind.itemsize * n


def encode(h: dict, z: np.ndarray) -> bytes:
    """Rows of numbers of any type, of colours packed as alpha, red, green, blue, or of places in a colour map."""
    kind, n = _sampled(h)
    if h["data_type"] == "PALETTED" and h.get("colours"):
        place = {c: k for k, c in reversed(list(enumerate(h["colours"])))}
        try:
            return bytes([place[int(c)] for c in z.ravel()])
        except KeyError as e:
            raise DataError(f"colour {e} is not in the colour map") from None
    if n == 1:
        return z.astype(kind).tobytes()
    p = z.astype(np.int64)
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24 & 255][:n], 2).astype("u1").tobytes()


def head(h: dict) -> bytes:
    """What stands before the rows: one uncompressed row a strip follows.  ``metadata`` goes into the description."""
    kind, n = _sampled(h)
    high, cols = h["rows"], h["cols"]
    order = ">" if h["byte_order"] == "BIG_ENDIAN" else "<"
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    photometric = 3 if h["data_type"] == "PALETTED" else 2 if n > 1 else 1
    area = h["pixel_is_area"]
    sx = (h["east"] - h["west"]) / (cols if area else max(1, cols - 1))
    sy = (h["north"] - h["south"]) / (high if area else max(1, high - 1))
    text, citation = b"", (h["crs_wkt"] or "").encode("latin-1", "replace")
    keys = [1024, 0, 1, 2 if "projcs[" not in (h["crs_wkt"] or "").lower() and not h["epsg"] else 1, 1025, 0, 1, 1 if area else 2]
    if citation and citation != b"PROJCS[]":
        text = citation + b"|\0"
        keys += [1026, 34737, len(citation) + 1, 0]
    if h["epsg"]:
        keys += [2048 if 4000 <= h["epsg"] < 5000 else 3072, 0, 1, h["epsg"]]
    strip = row_bytes(h)
    nodata = repr(int(h["nodata"]) if h["nodata"] == int(h["nodata"]) else h["nodata"]).encode() + b"\0"
    notes = "; ".join(h["metadata"] or []).encode("latin-1", "replace") + b"\0"
    colours = [c >> shift & 255 for shift in (16, 8, 0) for c in [*map(int, h.get("colours") or [0xFF000000 | 0x010101 * k for k in range(256)]), *[0] * 256][:256]]
    tags: list[tuple[int, int, list | bytes]] = [
        (256, 4, [cols]), (257, 4, [high]), (258, 3, [8 * kind.itemsize] * n), (259, 3, [1]), (262, 3, [photometric]),
        *([(270, 2, notes)] if len(notes) > 1 else []), (273, 4, [0] * high), (277, 3, [n]), (278, 4, [1]), (279, 4, [strip] * high), (284, 3, [1]),
        *([(320, 3, [c * 257 for c in colours])] if photometric == 3 else []), *([(338, 3, [2])] if n == 4 else []), (339, 3, [form] * n),
        (33550, 12, [sx, sy, 0.0]), (33922, 12, [0.0, 0.0, 0.0, h["west"], h["north"], 0.0]), (34735, 3, [1, 1, 0, len(keys) // 4, *keys]),
        *([(34737, 2, text)] if text else []), (42113, 2, nodata),
    ]
    extra_at = 8 + 2 + 12 * len(tags) + 4
    sizes = [len(v) * FIELD[k][1] for _, k, v in tags]
    data_at = extra_at + sum(s + s % 2 for s in sizes if s > 4)
    if data_at + strip * high >= 1 << 32:
        raise UnsupportedFormat("a TIFF file holds at most 4 GB")
    tags = [(c, k, [data_at + strip * r for r in range(high)] if c == 273 else v) for c, k, v in tags]
    entries, extra = [], b""
    for (code, k, v), size in zip(tags, sizes, strict=True):
        raw = v if isinstance(v, bytes) else struct.pack(order + FIELD[k][0] * len(v), *v)
        if size > 4:
            place = struct.pack(order + "I", extra_at + len(extra))
            extra += raw + b"\0" * (size % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries.append(struct.pack(order + "HHI", code, k, len(v)) + place)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(tags)) + b"".join(entries) + b"\0" * 4 + extra
