"""Removal of long repeated byte strings, by suffix arrays built in shards.

1. Anchors.  Every window of ``least`` bytes has one anchor: the gram of least
   hash in it, the leftmost of equals.  Equal windows have equal grams at equal
   places, so windows can only be equal within one anchor hash.  Consecutive
   windows with one anchor make a segment; no two windows of a segment are
   equal.  One scan emits a row for each segment: anchor hash, digest of its
   bytes (they reach ``length`` bytes beyond its last window's start), where it is.
2. Equal segments are counted before anything is compared (copies collapse in
   the map-side aggregate); anchors that occur once drop out, and an anchor whose
   segments are all equal is settled by that count.
3. The bytes of one representative of each remaining distinct segment are
   fetched, and segments are dealt by anchor hash to shards of bounded size.
4. Each shard builds a suffix array by two-stage sorting: suffixes smaller than
   their successors are sorted directly, the others are induced by scanning the
   buckets from left to right.  Adjacent common prefixes of ``length`` bytes or
   more mark the repeated windows; runs of prefixes of ``least`` bytes or more
   that come from several documents mark shared passages.
5. Marked windows go back to every place of their segment, and each document
   drops the bytes they cover.

Shards of one anchor hash grow with the number of *different* segments around
that gram.  The segments of an anchor with more than ``HOT_BYTES`` are cut anew
at anchors of a longer gram (``GRAMS``), which reaches beyond a common line, and
go through steps 2 to 4 again; the last gram is a whole window, of which equal
ones collapse, so that no anchor stays hot.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, partitions, sliced, tidy

GRAM = 48
GRAMS = (GRAM, 128, 208)  # of anchors that stay hot; a whole window follows
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PLACE_BITS = 24  # chunks are at most 2**24 bytes
CHUNK = 1 << 18  # bytes looked through at once; temporary arrays take some hundred times that
SHARD_BYTES = 4 << 20  # of a task
SORT_BYTES = 1 << 20  # that are sorted at once, but for whole anchors
HOT_BYTES = (2 << 20, 16 << 20)  # of an anchor that is cut anew, and of one that stays so although it was; that much is sorted at once
SEPARATOR = 0xFF  # in no UTF-8 text

_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full((1 << bits) + 1, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed polynomial hash, modulo 2**64, of every gram; only anchors rest on it, never equality."""
    n = len(data)
    bits = max(19, n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(int(BASE), bits)[:n], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * _powers(pow(int(BASE), -1, 1 << 64), bits)[: n + 1 - size])


def sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours, by running minima from both ends of blocks."""
    n = len(x)
    blocks = -(-n // size)
    padded = np.full(blocks * size, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def segments(data: np.ndarray, bounds: np.ndarray, least: int, reach: int, gram: int, ends: np.ndarray | None = None):
    """Segments of texts that lie one after another in ``data``; windows start in ``bounds[k]:bounds[k+1]`` and stay in it.

    Yields arrays ``(text, first, n, size, h, d1, d2)``: windows first..first+n-1
    (places in ``data``) of ``least`` bytes share the anchor hash ``h``.  ``size``
    bytes from first, ``reach`` beyond the last window's start if the text (up to
    ``ends[k]``) has them, have the 128-bit digest ``d1``, ``d2``.
    """
    n = int(bounds[-1])
    ends = bounds[1:] if ends is None else ends
    at, view, digest = 0, memoryview(data), xxhash.xxh3_128_digest
    while at + least <= n:
        block = data[at : min(n, at + CHUNK + least - 1)]
        grams = gram_hashes(block, gram)
        # high bits of the hash, then the place: the least is the leftmost of the least
        tagged = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
        best = sliding_minimum(tagged, least - gram + 1)
        anchor = (best & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        start = np.arange(len(anchor), dtype=np.int64)
        text = np.searchsorted(bounds, start + at, side="right") - 1
        valid = start + at + least <= bounds[text + 1]
        start, anchor, text = start[valid], anchor[valid], text[valid]
        if len(start):
            new = np.flatnonzero(np.diff(anchor) | (np.diff(start) != 1)) + 1
            a, b = np.concatenate([[0], new]), np.concatenate([new, [len(start)]]) - 1
            first, count, text = start[a] + at, b - a + 1, text[a]
            end = np.minimum(first + count - 1 + reach, ends[text])
            raw = b"".join([digest(view[i:j], k) for i, j, k in zip(first.tolist(), end.tolist(), count.tolist(), strict=True)])
            d = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield text, first, count, end - first, grams[anchor[a]].view(np.int64), d[:, 0], d[:, 1]
        at += CHUNK


# ---- two-stage suffix sorting ----


def _words(data: np.ndarray) -> np.ndarray:
    """For every place the eight bytes from there, big-endian, as one number (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; the last is not."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])  # runs of one byte end here
    kind = np.zeros(n, bool)
    if len(change):
        up = data[change] < data[change + 1]
        run = np.searchsorted(change, np.arange(n))  # a place's run, by its end
        inside = run < len(change)
        kind[inside] = up[run[inside]]
    return kind


def sort_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` ordered by their first ``depth`` bytes at least: eight bytes a round, only ties go on."""
    n = len(words)
    key = words[places]
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    todo = np.arange(len(out))
    at = 8
    while at < depth and len(todo):
        g = group[todo]
        same = g[1:] == g[:-1]
        tied = np.zeros(len(todo), bool)
        tied[1:] |= same
        tied[:-1] |= same
        todo = todo[tied]
        if not len(todo):
            break
        where = out[todo] + at
        key = np.where(where < n, words[np.minimum(where, n - 1)], np.uint64(0))
        g = group[todo]
        order = np.lexsort((key, g))
        out[todo], key, g = out[todo][order], key[order], g[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]  # a group's name is its first slot
        at += 8
    return out


def suffix_array(data: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Wanted suffixes in the order of their first ``depth`` bytes, by two-stage sorting; and the eight-byte words.

    Suffixes smaller than their successors are sorted directly.  Any other
    suffix follows from its successor: scanning the buckets (by first byte) from
    the left, each suffix places the one before it, if larger, at the front of
    its bucket.  A wanted suffix also needs its successors up to the first that
    is sorted directly; these are kept in the result.
    """
    n = len(data)
    words = _words(data)
    small = smaller_than_successor(data)
    # chains: a larger suffix needs the next place, and so on
    need = wanted.copy()
    ends = np.flatnonzero(small)
    if len(ends) < n:
        large = np.flatnonzero(wanted & ~small)
        k = np.searchsorted(ends, large)
        stop = np.where(k < len(ends), ends[np.minimum(k, len(ends) - 1)] if len(ends) else n - 1, n - 1)
        delta = np.zeros(n + 1, np.int64)
        np.add.at(delta, large, 1)
        np.add.at(delta, stop + 1, -1)
        need |= np.cumsum(delta[:-1]) > 0
    direct = sort_directly(words, np.flatnonzero(need & small), depth)
    first = data[direct]
    cut = np.searchsorted(first, np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    if need[n - 1] and not small[n - 1]:
        fronts[data[n - 1]].append(np.array([n - 1]))  # before it stands the empty suffix
    out = []
    for c in np.unique(data[need]) if need.any() else []:
        front = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        whole = [front]
        while len(front):  # in a run of one byte the scan meets what it has just placed
            before = front - 1
            front = before[(before >= 0) & need[before] & (data[before] == c) & ~small[before]]
            whole.append(front)
        whole.append(direct[cut[c] : cut[c + 1]])
        bucket = np.concatenate(whole)
        out.append(bucket)
        before = bucket - 1
        before = before[(before >= 0)]
        before = before[need[before] & ~small[before] & (data[before] > c)]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for d, part in zip(*_runs(byte, before), strict=True):
            fronts[d].append(part)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), words


def _runs(byte: np.ndarray, values: np.ndarray):
    if not len(byte):
        return [], []
    new = np.flatnonzero(np.diff(byte)) + 1
    return byte[np.concatenate([[0], new])].tolist(), np.split(values, new)


def common_prefix_reaches(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in the suffix array: whether their common prefix has ``length`` bytes or more."""
    a, b, n = order[:-1], order[1:], len(words)
    same = np.flatnonzero(np.maximum(a, b) + length <= n)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[words[a[same] + at] == words[b[same] + at]]
    out = np.zeros(len(a), bool)
    out[same] = True
    return out


def _touching(same: np.ndarray) -> np.ndarray:
    """Which entries of the suffix array have such a neighbour on either side."""
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _several(same: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which entries stand in a run of such neighbours with more than one document."""
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    several = np.minimum.reduceat(lo, start) != np.maximum.reduceat(hi, start)
    return np.repeat(several, np.diff(np.concatenate([start, [len(lo)]])))


def repeated_windows(
    pieces: list[bytes], windows: list[int], length: int, least: int | None = None, lo: list[int] | None = None, hi: list[int] | None = None
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each piece the windows (by start, below ``windows[k]``) whose ``length`` bytes also start elsewhere in the
    pieces, and those whose ``least`` bytes stand in several documents; ``lo`` and ``hi`` are a piece's first and last one."""
    least = length if least is None else least
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    data = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    delta = np.zeros(len(data) + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + np.array(windows), -1)
    wanted = np.cumsum(delta[:-1]) > 0
    order, words = suffix_array(data, wanted, length)
    order = order[wanted[order]]  # what induction passed through has served
    repeated, shared = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(order):
        of = np.searchsorted(starts, order, side="right") - 1
        whole = order + length <= starts[of] + sizes[of] - 1  # else a prefix of this length would cross a piece's end
        repeated[order] = _touching(common_prefix_reaches(words, order, length)) & whole
        if lo is not None:
            shared[order] = _several(common_prefix_reaches(words, order, least), np.array(lo)[of], np.array(hi)[of])
    cut = [(s, s + w) for s, w in zip(starts, windows, strict=True)]
    return [np.flatnonzero(repeated[a:z]) for a, z in cut], [np.flatnonzero(shared[a:z]) for a, z in cut]


def _ranges(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not len(x):
        return []
    new = np.flatnonzero(np.diff(x) != 1) + 1
    return list(zip(x[np.concatenate([[0], new])].tolist(), x[np.concatenate([new - 1, [len(x) - 1]])].tolist(), strict=True))


# ---- the operator ----

_KEY = ["h", "d1", "d2"]
_SPANS = "array<struct<a:int,z:int>>"
_PIECE = "h long, d1 long, d2 long, n int, copies long, lo long, hi long, bytes binary"
_LISTS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))


def _scan(least: int, reach: int):
    def run(batches):
        for b in batches:
            texts = b.column(1)
            raw = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            raw = raw.cast(pa.large_binary())
            bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if len(raw) else np.zeros(0, np.uint8)
            bounds = bounds - bounds[0]
            # texts of no bytes would confuse the search for a window's text
            full = np.flatnonzero(np.diff(bounds) > 0)
            edges = np.concatenate([bounds[full], bounds[-1:]])
            for text, first, n, size, h, d1, d2 in segments(data, edges, least, reach, GRAM):
                row = full[text]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(first - bounds[row]), pa.array(h), pa.array(d1), pa.array(d2), pa.array(n.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["rk", "first", *_KEY, "n", "size"],
                )

    return run


def _pieces_batch(rows):
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_KEY, "n", "copies", "lo", "hi", "bytes"]
    )


def _fetch(batches):
    """The bytes of each representative, from its document's text."""
    for b in sliced(batches):
        texts, lists = b.column("b").to_pylist(), b.column("reps").to_pylist()
        rows, size = [], 0
        for t, reps in zip(texts, lists, strict=True):
            for r in reps:
                rows.append((r["h"], r["d1"], r["d2"], r["n"], r["copies"], r["lo"], r["hi"], t[r["first"] : r["first"] + r["size"]]))
                size += r["size"]
                if size > 4_000_000:
                    yield _pieces_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _pieces_batch(rows)


def _sort_shards(length: int, least: int):
    """Suffix-sort a shard's pieces and give each its marked windows; a task's pieces come ordered by anchor hash."""

    def done(rows):
        bytes_, n, lo, hi = ([r[k] for r in rows] for k in (7, 3, 5, 6))
        repeated, shared = repeated_windows(bytes_, n, length, least, lo, hi)
        out = []
        for r, m, s in zip(rows, repeated, shared, strict=True):
            last = min(r[3], len(r[7]) - length + 1) - 1
            gone = ([(0, last)] if last >= 0 else []) if r[4] > 1 else _ranges(m)
            seen = _ranges(s)
            if gone or seen:
                out.append((r[1], r[2], *[[{"a": x, "z": y} for x, y in part] for part in (gone, seen)]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), _LISTS, _LISTS], strict=True)], ["d1", "d2", "gone", "seen"]
            )

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if size > SORT_BYTES and r[0] != rows[-1][0]:
                    yield from done(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield from done(rows)

    return run


def _recut(length: int, least: int, gram: int):
    """The pieces of hot anchors cut at anchors of a longer gram: (p1, p2) names the piece, ``at`` is the place in it."""

    def run(batches):
        for b in batches:
            for _, d1, d2, n, copies, lo, hi, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = np.frombuffer(raw, np.uint8)
                cuts = segments(data, np.array([0, n - 1 + least]), least, length, gram, np.array([len(data)]))
                for _, first, count, size, h, e1, e2 in cuts:
                    for at in range(0, len(first), 2048):
                        own = slice(at, at + 2048)
                        m = len(first[own])
                        parts = [raw[a : a + z] for a, z in zip(first[own].tolist(), size[own].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[pa.array([v] * m, pa.int64()) for v in (d1, d2)], pa.array(first[own].astype(np.int32)), *[pa.array(x[own]) for x in (h, e1, e2)],
                                pa.array(count[own].astype(np.int32)), *[pa.array([v] * m, pa.int64()) for v in (copies, lo, hi)], pa.array(parts, pa.binary()),
                            ],
                            ["p1", "p2", "at", *_KEY, "n", "copies", "lo", "hi", "bytes"],
                        )

    return run


def _hits(pieces: DataFrame, length: int, least: int, level: int = 0) -> DataFrame:
    """``(d1, d2, gone, seen)``: the windows of distinct pieces that are repeated, and that several documents share.

    ``pieces`` comes from settled tables.  Hot anchors are cut anew at the next gram.
    """
    spark = pieces.sparkSession
    width = F.octet_length("bytes").cast("long")
    gram = (*[g for g in GRAMS if g < least], least)
    hot = None
    if level + 1 < len(gram):
        hot = pieces.groupBy("h").agg(F.sum(width).alias("w")).filter(F.col("w") > HOT_BYTES[min(level, 1)]).select("h")
        hot = materialize(hot, "hot")
        hot = hot if hot.limit(1).count() else None
    total = pieces.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    shards = max(partitions(spark), -(-total // SHARD_BYTES))
    cool = pieces if hot is None else pieces.join(hot, "h", "left_anti")
    shard = cool.select(*_KEY, "n", "copies", "lo", "hi", "bytes").repartition(shards, "h").sortWithinPartitions("h")
    hits = shard.mapInArrow(tidy(_sort_shards(length, least)), f"d1 long, d2 long, gone {_SPANS}, seen {_SPANS}")
    if hot is None:
        return hits
    parts = pieces.join(hot, "h", "left_semi").select(*_KEY, "n", "copies", "lo", "hi", "bytes")
    parts = materialize(parts.mapInArrow(tidy(_recut(length, least, gram[level + 1])), f"p1 long, p2 long, at int, {_PIECE}"), "recut")
    distinct = parts.groupBy(*_KEY).agg(
        F.min("n").alias("n"), F.sum("copies").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("bytes").alias("bytes")
    )
    distinct = materialize(distinct, "pieces")
    often = materialize(distinct.groupBy("h").agg(F.sum("copies").alias("all")).filter("all > 1").select("h"), "anchors")
    found = _hits(distinct.join(often, "h", "left_semi"), length, least, level + 1)
    move = lambda c: F.transform(c, lambda m: F.struct((m["a"] + F.col("at")).alias("a"), (m["z"] + F.col("at")).alias("z")))
    back = parts.select("p1", "p2", "at", "d1", "d2").join(found, ["d1", "d2"]).select("p1", "p2", move("gone").alias("gone"), move("seen").alias("seen"))
    back = back.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("gone", "seen")])  # one piece's
    return hits.unionByName(back)


def _union(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted((y["a"], y["z"]) for y in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _drop(batches):
    """Only texts with marks are taken apart; the others' bytes stay where they are."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in sliced(batches):
        marked = b.column("gone").is_valid()
        part = b.filter(marked)
        kept, spans, seen = [], [[]] * b.num_rows, [[]] * b.num_rows
        rows = np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist()
        for k, t, g, s in zip(rows, *[part.column(c).to_pylist() for c in ("b", "gone", "seen")], strict=True):
            at, parts, runs = 0, [], _union(g)
            for a, z in runs:
                parts.append(t[at:a])
                at = z
            kept.append(b"".join([*parts, t[at:]]))
            spans[k] = [{"start": a, "end": z} for a, z in runs]
            seen[k] = [{"start": a, "end": z} for a, z in _union(s)]
        left = pc.replace_with_mask(b.column("b"), marked, pa.array(kept, b.column("b").type))
        yield pa.RecordBatch.from_arrays([b.column("_id"), left, pa.array(spans, kind), pa.array(seen, kind)], ["_id", "kept", "spans", "shared"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, least: int | None = None) -> DataFrame:
    """Drop every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns ``(<id_col>, kept binary, spans, shared)``, a row for a row: the
    remaining UTF-8 bytes, the maximal removed runs, and the maximal runs of the
    input covered by ``least``-byte strings (default: ``length``) that another
    document has too; spans are ``array<struct<start,end>>``.  All copies of a
    string are dropped, the first as well; strings are judged on the input;
    matches don't cross documents.  A null text is empty; texts under ``least``
    bytes come back whole; rows with equal or null ids are different documents;
    an empty table gives an empty result; other columns are ignored.
    """
    least = length if least is None else least
    if not GRAM + 8 <= least <= length:
        raise ValueError(f"least must be at least {GRAM + 8} and at most length")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    whole = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")), "_id", "_t")
    whole = whole.select("rk", "_id", F.coalesce(F.col("_t").cast("binary"), F.lit(b"")).alias("b"))
    long_enough = whole.select("rk", "b").filter(F.octet_length("b") >= least)
    found = long_enough.mapInArrow(tidy(_scan(least, length)), "rk long, first long, h long, d1 long, d2 long, n int, size int")

    # equal segments collapse; anchors that occur once can't repeat, those with one distinct segment need no sorting
    distinct = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rk", "first", "n", "size")).alias("rep"), F.max("rk").alias("hi"))
    distinct = materialize(distinct, "segments")
    anchors = materialize(distinct.groupBy("h").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1"), "anchors")
    several = distinct.join(anchors.filter("kinds > 1").select("h"), "h", "left_semi")
    reps = several.select(
        F.col("rep.rk").alias("rk"),
        F.struct(*_KEY, "rep.n", "copies", F.col("rep.rk").alias("lo"), "hi", "rep.first", "rep.size").alias("r"),
    )
    reps = reps.groupBy("rk").agg(F.collect_list("r").alias("reps"))  # as many as the document's length allows
    dealt = whole.repartition(partitions(spark), "rk")
    pieces = materialize(dealt.select("rk", "b").join(reps, "rk").select("b", "reps").mapInArrow(tidy(_fetch), _PIECE), "pieces")
    hits = _hits(pieces, length, least)

    copies = distinct.filter("copies > 1").join(anchors.filter("kinds = 1").select("h"), "h", "left_semi")
    run = lambda last: F.array(F.struct(F.lit(0).alias("a"), last.cast("int").alias("z")))
    none = F.array().cast(_SPANS)
    last = F.least(F.col("rep.n"), F.col("rep.size") - length + 1) - 1
    copies = copies.select(
        "d1", "d2", F.when(last >= 0, run(last)).otherwise(none).alias("gone"),
        F.when(F.col("rep.rk") != F.col("hi"), run(F.col("rep.n") - 1)).otherwise(none).alias("seen"),
    ).filter("size(gone) + size(seen) > 0")
    hits = materialize(hits.unionByName(copies), "hits")

    place = lambda c, wide: F.transform(c, lambda m: F.struct((F.col("first") + m["a"]).alias("a"), (F.col("first") + m["z"] + wide).alias("z")))
    spans = found.select("rk", "first", "d1", "d2").join(hits, ["d1", "d2"]).select("rk", place("gone", length).alias("gone"), place("seen", least).alias("seen"))
    spans = spans.groupBy("rk").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("gone", "seen")])  # one document's
    out = dealt.join(spans, "rk", "left").select("_id", "b", "gone", "seen")
    places = "array<struct<start:long,end:long>>"
    return out.mapInArrow(tidy(_drop), f"_id {kind}, kept binary, spans {places}, shared {places}").withColumnRenamed("_id", id_col)
