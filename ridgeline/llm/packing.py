"""Packing token sequences by fitted length patterns.

Every document is cut into pieces of at most ``capacity`` tokens.  The pieces'
length histogram has ``capacity`` cells whatever the corpus, so the packing is
planned on the driver over the histogram alone: all patterns of up to three
lengths that fill a sequence exactly are enumerated, non-negative least squares
fits how often each is repeated, the counts are rounded down to what the
histogram can supply, and the residual lengths are packed best fit first, still
as (pattern, count) groups.  The plan becomes a table of slot intervals for each
length; executors rank the pieces of a length and look their slots up.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import apart, materialize, tidy

CAPACITY = 2048
CACHE_CHUNKS = 300_000  # most entries of each of a worker's tables
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
LINES = re.compile(f"^(?:{PLAIN.pattern}|.+)$", re.MULTILINE)  # PLAIN, or nothing, for each line
ODD_SPACE = tuple("\x1c\x1d\x1e\x1f")


@dataclass
class Plan:
    """Slot intervals: pieces ranked lo.. of ``length`` go to sequences first.. at ``offset``."""

    length: np.ndarray
    lo: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of the given lengths that sum to ``capacity``; 0 stands for no document."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    found = []
    for a in np.flatnonzero(have):  # a <= b <= c
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        keep = have[b] & have[c] & (c >= b)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], 1))
    out = np.concatenate(found)
    return out[out[:, 2] > 0]


def nnls(rows: np.ndarray, histogram: np.ndarray, weight: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |weight * (A x - histogram)| with A's columns given by ``rows`` (cells, 0 for none).

    Accelerated projected gradients; a step costs time in proportion to the patterns.
    """
    size, used = len(histogram), rows > 0
    w2 = weight**2

    def times(x):
        return np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]) * used.ravel(), size)

    def back(r):
        return ((w2 * r)[rows] * used).sum(1)

    x = np.zeros(len(rows))
    v = np.random.default_rng(0).random(len(rows))
    for _ in range(12):  # the largest eigenvalue, for the step size
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    y, t, step = x, 1.0, 1 / (1.05 * top)
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - histogram))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fit patterns to a histogram of lengths from 1 to ``capacity``; uses every piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    groups: list[tuple[tuple[int, ...], int]] = []  # a pattern and how many sequences have it
    if left[capacity]:
        groups.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        rows = patterns(lengths, capacity)
        if len(rows):
            scale = max(1.0, left.max() / 1e3)
            weight = np.sqrt(np.arange(capacity + 1) / capacity)  # a long piece left over costs more
            x = nnls(rows, left / scale, weight) * scale
            for j in np.argsort(-x, kind="stable"):
                if x[j] < 0.5:
                    break
                cells, times = np.unique(rows[j][rows[j] > 0], return_counts=True)
                n = int(min(round(x[j]), (left[cells] // times).min()))
                if n > 0:
                    left[cells] -= n * times
                    groups.append((tuple(int(v) for v in rows[j] if v), n))
        groups += residual(left, capacity)
    return intervals(groups)


def residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal sequences stay together as one group."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by the space left
    for size in np.flatnonzero(left)[::-1]:
        size, n = int(size), int(left[size])
        while n:
            space = min((s for s in open_ if s >= size), default=None)
            if space is None:
                k = capacity // size
                if n >= k:
                    open_.setdefault(capacity - k * size, []).append(((size,) * k, n // k))
                    n %= k
                else:
                    open_.setdefault(capacity - n * size, []).append(((size,) * n, 1))
                    n = 0
                continue
            pattern, m = open_[space].pop()
            if not open_[space]:
                del open_[space]
            k = min(space // size, n)
            take = min(m, n // k)
            if m > take:
                open_.setdefault(space, []).append((pattern, m - take))
            open_.setdefault(space - k * size, []).append((pattern + (size,) * k, take))
            n -= take * k
    return [g for rest in open_.values() for g in rest]


def intervals(groups: list[tuple[tuple[int, ...], int]]) -> Plan:
    taken: dict[int, int] = {}
    out, first = [], 0
    for pattern, n in groups:
        at = 0
        for size in pattern:
            lo = taken.get(size, 0)
            out.append((size, lo, first, at))
            taken[size] = lo + n
            at += size
        first += n
    a = np.array(sorted(out), np.int64).reshape(-1, 4)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], first)


def renewed(table: dict[str, bytes], wanted: set[str], lacking: set[str]) -> dict[str, bytes]:
    """The table, or, where it would grow too large, what is wanted of it."""
    if len(table) + len(lacking) <= CACHE_CHUNKS:
        return table
    return {c: table[c] for c in wanted - lacking}


class LibraryIds:
    """Ids by the tokenizers library; chunks between white space are kept in a bounded table."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.symbols = byte_symbols()
        # what the tables rest on is asked of the vocabulary, not taken for granted
        words, gaps = ("Hello", "WORLD", "\u00e9t\u00c9", "naïve", "don't", "x1", "中文", "a"), (" ", "  ", "\n", "\t\n ")
        one = lambda t: self.ids([t])[0]
        self.chunked = all(one(f"{g}{a}{g}{b}{g}") == one(a) + one(b) for a in words for b in words[:4] for g in gaps)
        self.folded = self.chunked and all(one(w) == one(w.lower()) and one(w + m) == one(w) + one(m) for w in words[:4] for m in ".,;:!?")
        low = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c) and c == c.lower()]
        self.spelt = self.folded and self.spell(few := [*low, *[a + b for a in low for b in low], *[w.lower() for w in words[:4]]]) == dict(zip(few, self.ids(few), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, chunks: list[str], step: int = 2_000) -> dict[str, bytes]:
        """Ids of each chunk: one text of ``step`` of them is encoded, and each token goes to the chunk it starts in."""
        out: dict[str, bytes] = {}
        for at in range(0, len(chunks), step):
            part = chunks[at : at + step]
            got = self.tokenizer.encode_batch([" ".join(part)], add_special_tokens=False)[0]
            ends = np.cumsum([len(c) + 1 for c in part])  # a chunk's blank counts as its own
            of = np.searchsorted(ends, np.array([o[0] for o in got.offsets], np.int64), side="right")
            cut = (np.searchsorted(of, np.arange(len(part) + 1)) * 4).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            out.update([(c, raw[cut[k] : cut[k + 1]]) for k, c in enumerate(part)])
        return out

    def spell(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small letters by the library's model alone, which takes the symbols of a word's bytes."""
        encode, symbols = self.tokenizer.model.tokenize, self.symbols
        return {w: array("I", [t.id for t in encode(w if w.isascii() else "".join([symbols[b] for b in w.encode()]))]).tobytes() for w in words}

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the table lacks.  Where letters and one mark behind them are words of their own to the
        tokenizer, and case is dropped, such a chunk is put together from what is known of its parts."""
        if not self.folded:
            return self.apart(chunks)
        parts = LINES.findall("\n".join(chunks))  # no chunk holds white space
        low = " ".join([w for w, _ in parts]).lower().split(" ")
        wanted = set(low) - {""}
        lacking = wanted.difference(self.words)
        self.words = words = renewed(self.words, wanted, lacking)
        words.update((self.spell if self.spelt else self.apart)(list(lacking)))
        marks = self.apart(list({m for _, m in parts if m}))
        out, rest = {}, []
        for c, w, (_, m) in zip(chunks, low, parts, strict=True):
            if w:
                out[c] = words[w] + marks[m] if m else words[w]
            else:
                rest.append(c)
        out.update(self.apart(rest))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what the table lacks is looked for once for all the texts.  Whole texts go to the library
        where white space doesn't part them into chunks of their own."""
        if not self.chunked:
            return self.ids(texts)
        collects = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            # str.split() would split at ODD_SPACE, the tokenizer doesn't
            lists = [None if any(c in text for c in ODD_SPACE) else text.split() for text in texts]
            wanted = set(chain.from_iterable(filter(None, lists)))
            lacking = wanted.difference(self.table)
            self.table = renewed(self.table, wanted, lacking)
            if lacking:
                self.table.update(self.learn(list(lacking)))
            of = self.table.__getitem__
            return [self.ids([text])[0] if x is None else b"".join(map(of, x)) for text, x in zip(texts, lists, strict=True)]
        finally:
            if collects:
                gc.enable()


@lru_cache(maxsize=2)
def library(path: str) -> LibraryIds:
    return LibraryIds(path)


def _by_hundreds(lib: LibraryIds, texts: pa.Array, step: int = 256):
    for at in range(0, len(texts), step):
        yield from lib.encode_all([t or "" for t in texts.slice(at, step).to_pylist()])


def pieces(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``(<id_col>, piece, start, length, ids_crc32)`` for every piece of at most ``capacity`` tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        lib = library(vocab_path)
        for b in batches:
            at, out = [], []
            for k, ids in enumerate(_by_hundreds(lib, b.column(1))):
                ids += end
                for s in range(0, len(ids), width):
                    part = ids[s : s + width]
                    at.append(k)
                    out.append((s // width, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                ["_id", "piece", "start", "length", "ids_crc32"],
            )

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(
        tidy(run), f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    )
    return got.withColumnRenamed("_id", id_col)


def ranked(cut: DataFrame, id_col: str, n: int, each: int = 20_000) -> DataFrame:
    """Number the pieces of each length from 0, in ``_rank``, without gathering a length in one task.

    Each length is dealt over enough salts that a salt holds about ``each``
    pieces even if all have one length; a salt's pieces are numbered from where
    the salts before it end.
    """
    salts = max(16, -(-n // each))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32"), F.lit(salts)))
    sizes = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = W.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32", "start")
    return (
        cut.withColumn("_k", F.row_number().over(within) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_rank", F.col("_from") + F.col("_k"))
        .drop("_salt", "_from", "_k")
    )


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: ``(<id_col>, piece, start, length, ids_crc32, sequence_id, offset)``.

    A null text is empty and still has its closing id 0.  Rows with equal or null
    ids are packed separately.  An empty table gives an empty result.  Only
    documents longer than ``capacity`` are cut.  Other columns are ignored; an id
    column named as one of the result's is an error.
    """
    apart(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    cut = materialize(pieces(docs, vocab_path, id_col, text_col, capacity), "pieces")
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    p = plan(counts, capacity)
    # at most a few intervals for each length and pattern, however many documents there are
    code, first, offset, lo = p.length << 40 | p.lo, p.first, p.offset, p.lo
    schema = cut.schema.fields
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(code, length << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in schema], pa.array(first[k] + rank - lo[k]), pa.array(offset[k])],
                [*[f.name for f in schema], "sequence_id", "offset"],
            )

    return ranked(cut, id_col, sum(counts.values())).mapInArrow(tidy(place), spec)


def sequences_needed(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The least number of sequences that any packing can use."""
    return -(-sum(k * n for k, n in counts.items()) // capacity)


__all__ = ["pack", "plan", "pieces", "ranked", "sequences_needed"]
