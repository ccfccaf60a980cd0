"""WARC archives: writing with segmented records, and reading with reassembly.

A page becomes a ``response`` record whose HTTP block uses chunked transfer
framing.  A block longer than ``segment_bytes`` is cut: the first part is the
``response`` record, the others are ``continuation`` records that name its
identifier and their number, the last one the total length.  The reader groups
continuation records by origin identifier, orders them by number, verifies the
total length, and undoes the chunked framing.

Records are compressed one by one, as members of a gzip file, and written by
Spark's text writer, whose line separator is an empty member; so the archives are
committed like any other output and any file system Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialize, new_path

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4_096
FILE_RECORDS = 2_000
LEAST_REVISIT_BYTES = 1_000
STEP = 1 << 14  # bytes of a compressed file fed at once
LEVEL = 4  # of compression
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"


# ---- framing ----


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over, a broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk ends early")
        out.append(part)
        at += size + 2


def record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [VERSION, *[k + b": " + v for k, v in headers], b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def inflated(data: bytes):
    """The bytes of all members of a gzip file, in pieces; other data as it is.

    The file is fed in small steps, as what follows a member's end is copied.
    """
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        if not any(view[at : at + 2]) and not any(view[at:]):
            return  # padding
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(data):
                raise ValueError("a member ends early")
            part = view[at : at + STEP]
            yield d.decompress(part)
            at += len(part) - len(d.unused_data)


def records(pieces):
    """(headers with lower-case names, block) of every record in consecutive pieces of bytes; Content-Length alone
    says where a block ends.  What is held is one record and one piece."""
    held, pieces, open_ = bytearray(), iter(pieces), True

    def fill() -> bool:
        nonlocal open_
        piece = next(pieces, None)
        open_ = piece is not None
        held.extend(piece or b"")
        return open_

    while True:
        while len(held) < 5 and open_ and fill():
            pass
        if held.startswith(CRLF):
            del held[:2]
            continue
        if not held:
            return
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {bytes(held[:20])!r}")
        seen = 0
        while (end := held.find(CRLF * 2, seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill():
                raise ValueError("a record's head ends early")
        head = {}
        for line in bytes(held[:end]).split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode()] = v.strip().decode()
        size, at = int(head["content-length"]), end + 4
        while len(held) < at + size:
            if not fill():
                raise ValueError("a record ends early")
        block = bytes(memoryview(held)[at : at + size])
        del held[: at + size]
        yield head, block


def page_records(name: str, page_id, uri: str, payload: bytes, refers: str | None, segment_bytes: int) -> list[bytes]:
    digest = b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
    own = b"<" + name.encode() + b">"
    head = [(b"WARC-Record-ID", own), (b"WARC-Date", DATE), (b"WARC-Target-URI", uri.encode()), (b"WARC-Payload-Digest", digest)]
    if page_id is not None:
        head.append((b"X-Page-ID", str(page_id).encode()))
    kind = (b"Content-Type", b"application/http;msgtype=response")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        extra = [(b"WARC-Type", b"revisit"), (b"WARC-Refers-To", b"<" + refers.encode() + b">"), (b"WARC-Profile", PROFILE), kind]
        return [record(head + extra, http)]
    block = http + chunked(payload)
    parts = [block[a : a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record([*head, (b"WARC-Type", b"response"), kind], block)]
    out = [record([*head, (b"WARC-Type", b"response"), kind, (b"WARC-Segment-Number", b"1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [
            (b"WARC-Record-ID", b"<" + f"{name}:{k}".encode() + b">"), (b"WARC-Date", DATE), (b"WARC-Type", b"continuation"),
            (b"WARC-Segment-Origin-ID", own), (b"WARC-Segment-Number", str(k).encode()),
        ]
        if k == len(parts):
            more.append((b"WARC-Segment-Total-Length", str(len(block)).encode()))
        out.append(record(more, part))
    return out


# ---- writing ----


def write(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` to gzipped archives under ``path``, a member a record.

    Of equal payloads of at least ``least`` bytes the row with the largest id
    (null ids are smaller than any) is the response, the others are revisits.  A
    null html is an empty payload, a null or missing url an empty one; ids may be
    null or repeated; an empty table writes no record; other columns are ignored.
    """
    has_url = url_col in pages.columns
    whole = keyed(pages, id_col, html_col, *[url_col] * has_url)
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7f]+", "%20") if has_url else F.lit("")
    rows = whole.select("rk", F.col(id_col).alias("_id"), html.alias("p"), url.alias("url"))
    sums = rows.select("rk", "_id", F.sha1("p").alias("d"), F.octet_length("p").alias("n")).filter(F.col("n") >= least)
    first = sums.groupBy("d").agg(F.max(F.struct(F.col("_id").isNotNull(), "_id", "rk")).alias("m"), F.count(F.lit(1)).alias("k"))
    first = first.filter("k > 1").select("d", F.col("m.rk").alias("response"))
    again = sums.join(first, "d").filter("rk != response").select("rk", F.col("response").alias("refers"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for rk, page, p, uri, refers in zip(*[c.to_pylist() for c in b.slice(at, 64).columns], strict=True):
                    out += page_records(f"urn:page:{rk}", page, uri, p, None if refers is None else f"urn:page:{refers}", segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([member(x) for x in out], pa.binary())], ["r"])

    made = rows.join(again, "rk", "left").select("rk", "_id", "p", "url", "refers").mapInArrow(run, "r binary")
    # a separator can't be empty, but it can be a member of nothing
    made.select(F.col("r").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


# ---- reading ----

_ROW = "id string, origin string, segment int, total long, type string, page string, uri string, digest string, refers string, block binary"


def _parse(batches):
    names = [f.split()[0] for f in _ROW.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for raw in b.column(0):
            rows, size = [], 0
            for h, block in records(inflated(raw.as_py())):
                own = h["warc-record-id"].strip("<>")
                part = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                total = h.get("warc-segment-total-length")
                rows.append((
                    own, h.get("warc-segment-origin-id", f"<{own}>").strip("<>"), part, None if total is None else int(total), h["warc-type"],
                    h.get("x-page-id"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to", "").strip("<>") or None, block,
                ))
                size += len(block)
                if size > 8_000_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


CHUNKED = re.compile(rb"\r\ntransfer-encoding:[ \t]*chunked[ \t]*(?=\r\n)", re.I)


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF * 2)
    return unchunked(body) if CHUNKED.search(head + CRLF) else body


def _payloads(batches):
    for b in batches:
        out, digest = [], []
        for kind, block in zip(b.column("type").to_pylist(), b.column("block").to_pylist(), strict=True):
            p = None if kind == "revisit" else payload_of(block)
            out.append(p)
            digest.append(None if p is None else "sha1:" + base64.b32encode(hashlib.sha1(p).digest()).decode())
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _HEAD], pa.array(out, pa.binary()), pa.array(digest, pa.string())], [*_HEAD, "payload", "computed"])


_HEAD = ["id", "type", "page", "uri", "digest", "refers"]
_TEXT = "id string, type string, page string, uri string, digest string, refers string"


def _reassemble(batches):
    """Segments of a record in order, their numbers and the total length verified, joined once."""
    for b in batches:
        blocks = []
        for origin, own, total, s in zip(*[b.column(c).to_pylist() for c in ("origin", "id", "total", "s")], strict=True):
            s.sort(key=lambda x: x["segment"])
            block = b"".join([x["block"] for x in s])
            if own is None or total != len(block) or [x["segment"] for x in s] != list(range(1, len(s) + 1)):
                raise ValueError(f"incomplete segments of {origin}")
            blocks.append(block)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _HEAD], pa.array(blocks, pa.binary())], [*_HEAD, "block"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(id, type, page, uri, digest, refers, payload, computed)``, a row for each response or revisit in the files of ``path``.

    Files of any name are read, gzipped (a member a record, or otherwise) or not.
    ``payload`` is decoded and whole, null for revisits; ``digest`` is what the
    record says and ``computed`` what its payload has.  Other types of records are
    left out; files without records give no rows.  Segments that are missing,
    doubled or of another total length, and broken frames, are errors.  Only
    segments are shuffled, so the files are read once for them and once for the rest.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_parse, _ROW).filter("type in ('response', 'revisit', 'continuation')")
    single = rows.filter("segment is null")
    parts = rows.filter("segment is not null").groupBy("origin").agg(
        F.collect_list(F.struct("segment", "block")).alias("s"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in _HEAD],
    )
    whole = parts.mapInArrow(_reassemble, f"{_TEXT}, block binary")
    return single.select(*_HEAD, "block").unionByName(whole).mapInArrow(_payloads, f"{_TEXT}, payload binary, computed string")


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to new archives and read them: ``(<id_col>, payload_bytes, payload_digest, record_type, refers_to)``.

    Revisits take length and digest from the response they refer to, which must
    have the digest they state.  A null html is an empty payload; rows with null
    or repeated ids are records of their own; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    got = read(spark, path).select(
        "id", "type", F.col("page").cast(kind).alias("page"), "refers", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("hex"),
        (F.col("type") == "revisit").alias("again"), (F.col("computed") != F.col("digest")).alias("wrong"),
    )
    got = materialize(got, "read")  # no payloads
    bad = F.raise_error(F.concat(F.lit("wrong digest in "), F.col("id")))
    responses = got.filter("not again").select(
        "page", "n", F.when(F.col("wrong"), bad).otherwise(F.col("hex")).alias("hex"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to")
    )
    named = got.filter("not again").select(F.col("id").alias("rid"), F.col("page").alias("of"), F.col("n").alias("rn"), F.col("hex").alias("rhex"), F.col("digest").alias("rdigest"))
    back = got.filter("again").join(named, F.col("refers") == F.col("rid"), "left")
    lost = F.raise_error(F.concat(F.col("id"), F.lit(" refers to no equal payload")))
    back = back.select(
        "page", F.col("rn").alias("n"), F.when(F.col("rid").isNull() | (F.col("rdigest") != F.col("digest")), lost).otherwise(F.col("rhex")).alias("hex"),
        F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"),
    )
    return responses.unionByName(back).select(
        F.col("page").alias(id_col), F.col("n").alias("payload_bytes"), F.col("hex").alias("payload_digest"), "record_type", "refers_to"
    )
