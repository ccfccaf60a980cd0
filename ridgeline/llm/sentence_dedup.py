"""Removal of repeated passages by sliding spans of sentences.

Every run of ``run`` consecutive sentences, and of more where those hold too few
words, is hashed, case and spacing aside.  Of any ``WINDOW`` words in a row
within a sentence one ends a piece, chosen by the words alone, and such pieces
stand for sentences.  Which of 51 shared words end a piece depends on the text
around them only for the ``WINDOW - 1`` on either side, and between these
three whole pieces always have room: wherever a passage starts, it holds a run.
The hashes are counted over all documents at once; repeated ones are kept with
their places and get the first of these (the least document key and run number),
and the sentences covered by any repeated span that isn't the first one go.  A document's spans
are rows, so a passage that a third of all documents share is a hash counted
with partial aggregates and a join that splits its hot key.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keyed, materialize, sliced, tidy

RUN = 3
LEAST_WORDS = 12
WINDOW = 8
# letters of scripts that put no blanks between words; two count as a word
LETTERS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED = re.compile(f"[{LETTERS}]")
WORD = re.compile(rf"[{LETTERS}][^\s{LETTERS}]*|[^\s{LETTERS}]+")
CLAUSE_ENDS = ",;:|，、；："
# a sentence ends after its marks and the white space behind them, or at a line's end
SENTENCE = re.compile(r"[^.!?…。\n]*(?:[.!?…。]+(?:[\"'”’)\]]*)(?:\s+|$|(?=\S))|\n\s*|$)")


class Ranks(dict):
    """By which of the words in a window one is chosen to end a piece: the least; those with a clause's mark come first."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        rank = self[word] = -1 if word[-1] in CLAUSE_ENDS else zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return rank


RANKS = Ranks()


def chosen(ranks: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least rank (of equal ones the last) of every window."""
    out, at, least = [], -1, 0
    for a in range(len(ranks) - window + 1):
        if at < a:
            part = ranks[a : a + window]
            least = min(part)
            at = a + window - 1 - part[::-1].index(least)
        elif ranks[a + window - 1] <= least:
            at = a + window - 1
            least = ranks[at]
        else:
            continue
        out.append(at)
    return out


def pieces(text: str):
    """(start, end, words) of consecutive pieces that cover the text: sentences, cut behind the chosen words."""
    blank = text.isascii() or not UNSPACED.search(text)
    for m in SENTENCE.finditer(text):
        a, z = m.span()
        if a == z:
            continue
        words = text[a:z].lower().split() if blank else [w.lower() for w in WORD.findall(text, a, z)]
        if len(words) >= WINDOW:
            ends = chosen([RANKS[w] for w in words])
            if ends[-1] == len(words) - 1:
                ends.pop()
            if ends:
                starts = [w.start() for w in WORD.finditer(text, a, z)]
                at = 0
                for k in ends:
                    yield a, starts[k + 1], words[at : k + 1]
                    a, at = starts[k + 1], k + 1
                words = words[at:]
        yield a, z, words


def sentences(text: str) -> list[tuple[int, int]]:
    """Consecutive (start, end) that cover the text; a sentence of at least ``WINDOW`` words is cut into pieces."""
    return [(a, z) for a, z, _ in pieces(text)]


def said(text: str) -> tuple[list[tuple[int, int]], list[str], list[int]]:
    """Places of the sentences that have words, their words joined, and how many those are."""
    where, what, counts = [], [], []
    plain = text.isascii()
    for a, z, words in pieces(text):
        if words:
            where.append((a, z))
            what.append(" ".join(words))
            counts.append(len(words) if plain else len(words) - len(UNSPACED.findall(text, a, z)) // 2)
    return where, what, counts


def runs(counts: list[int], run: int, least_words: int) -> list[tuple[int, int]]:
    """From each sentence the least run of ``run`` or more that hold ``least_words``; at last one up to the end of the text.

    A text with fewer sentences is one run if it holds the words, else it has none.
    """
    out, z, words = [], 0, 0
    for a, count in enumerate(counts):
        while z < len(counts) and (z - a < run or words < least_words):
            words += counts[z]
            z += 1
        if z - a < run or words < least_words:
            break
        out.append((a, z))
        words -= count
    if out and out[-1][1] < len(counts):
        out.append((out[-1][0], len(counts)))
    return out or ([(0, len(counts))] if sum(counts) >= least_words else [])


def span_hashes(text: str, run: int, least_words: int) -> list[tuple[int, int]]:
    """(number of the run, its hash) of every run; sentences without a word don't count."""
    _, what, counts = said(text)
    digest = xxhash.xxh64_intdigest
    return [(k, digest("\n".join(what[a:z])) - (1 << 63)) for k, (a, z) in enumerate(runs(counts, run, least_words))]


def spans(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(rk, at, h)`` for every span of ``(rk, t)``."""

    def go(batches):
        for b in sliced(batches):
            rows, at, h = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for j, x in span_hashes(t, run, least_words):
                    rows.append(k)
                    at.append(j)
                    h.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(h, pa.int64())], ["rk", "at", "h"]
            )

    return docs.mapInArrow(tidy(go), "rk long, at int, h long")


def _cut(run: int, least_words: int, carried: int):
    """Columns t, hits and the carried ones become kept, removed, n_sentences_removed and the carried ones."""

    def go(batches):
        for b in sliced(batches):
            kept, dropped, total = [], [], []
            for t, hit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, _, counts = said(t) if hit else ([], [], [])
                every = runs(counts, run, least_words) if hit else []
                gone = sorted({k for j in hit or () for k in range(*every[j])})
                cuts: list[list[int]] = []
                for k in gone:
                    a, z = where[k]
                    if cuts and cuts[-1][1] == a:
                        cuts[-1][1] = z
                    else:
                        cuts.append([a, z])
                at, parts = 0, []
                for a, z in cuts:
                    parts.append(t[at:a])
                    at = z
                kept.append("".join([*parts, t[at:]]) if gone else t)
                dropped.append([{"start": a, "end": z} for a, z in cuts])
                total.append(len(gone))
            spans = pa.array(dropped, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.string()), spans, pa.array(total, pa.int64()), *b.columns[2:]],
                ["kept", "removed", "n_sentences_removed", *[f"_k{i}" for i in range(carried)]],
            )

    return go


def remove_repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, least_words: int = LEAST_WORDS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(<id_col>, kept string, removed array<struct<start,end>>, n_sentences_removed)`` and ``carry``, a row for a row.

    ``kept`` is the text without the removed sentences; ``removed`` has their
    character places.  A null text stays null.  Of equal spans the one with the
    least id (then the earliest) stays; of repeated rows one stays.  A text of
    fewer than ``run`` sentences is a span of its own; texts of fewer than
    ``least_words`` words come back whole, as do empty ones; an empty table gives
    an empty result; other columns are ignored.
    """
    names = (id_col, *carry)
    kinds = [docs.schema[c].dataType.simpleString() for c in names]
    own = [f"_k{i}" for i in range(len(names))]
    whole = keyed(docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(c).alias(k) for c, k in zip(names, own, strict=True)]), "_k0", "t", *own[1:])
    spark = docs.sparkSession
    every = materialize(spans(whole.select("rk", "t").filter("t is not null"), run, least_words), "spans")
    # what spans are joined with is settled, so that a passage of very many documents is a key whose rows Spark can split
    often = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "often")
    found = materialize(every.join(often, "h", "left_semi"), "repeated")
    forget(spark, every)  # nothing below reads it, and it is as large as half the texts
    forget(spark, often)
    first = materialize(found.groupBy("h").agg(F.min(F.struct("rk", "at")).alias("first")), "first")
    again = found.join(first, "h").filter(F.struct("rk", "at") != F.col("first"))
    hits = again.groupBy("rk").agg(F.collect_set("at").alias("hits"))  # as many as the document has sentences
    out = whole.join(hits, "rk", "left").select("t", "hits", *[f"_k{i}" for i in range(len(names))])
    spec = ", ".join(f"_k{i} {k}" for i, k in enumerate(kinds))
    cut = out.mapInArrow(tidy(_cut(run, least_words, len(names))), f"kept string, removed array<struct<start:long,end:long>>, n_sentences_removed long, {spec}")
    return cut.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], "kept", "removed", "n_sentences_removed")
