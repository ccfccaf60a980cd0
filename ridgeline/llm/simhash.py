"""SimHash near-duplicates, compared at anchor points of a covering code.

A fingerprint's 64 bits are cut into three blocks of 21, 21 and 22 bits.  Two
fingerprints that differ in at most 4 bits differ in at most 1 bit of some block
(and in at most 2 bits of some pair of blocks).  The anchors of a block are the
words of the perfect binary Golay code of length 23, whose covering radius is 3
(a block's missing bits count as zero).  Each fingerprint is at home at the one
anchor within the radius of its block and is replicated to every anchor within
radius plus threshold, 3 + 1; two fingerprints that differ in at most 1 bit of
the block therefore meet at either one's home.  For many fingerprints the
anchors are pairs of code words over two blocks, with threshold 2 over both:
2**24 anchors for each pair instead of 2**12.

Equal fingerprints are one node, so copies are never compared.  What meets at an
anchor is compared there, and only a spanning forest of the links found is
emitted, so that a group of near copies costs edges in proportion to its size.
An anchor with more than ``HOT`` fingerprints is cut into blocks that are
compared two by two, in different tasks.

``similar_documents`` finds what is alike in its word shingles, however the
threshold of bits would fall: fingerprints of the set of words, which differ in
few bits even where shingles differ in a fifth, propose candidates at the anchors
(radius plus 2, ``WIDE_THRESHOLD`` bits), parities of the sets of shingles travel
with them and rule out what can't be similar, and the shingles themselves decide:
first for the few likeliest candidates of each, as rows, then for all that are left,
at the anchors, so that no rows are made for the pairs of a group.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, forget, keyed, materialize, partitions, sliced, tidy
from .components import components

BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
GENERATOR = 0b101011100011  # of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
RADIUS = 3
THRESHOLD = 4
MANY = 3_000_000  # more fingerprints than this use pairs of blocks
HOT = 20_000


# ---- fingerprints ----


def fingerprint(text: str, words_in_shingle: int = 4, seed: int = 42) -> int:
    """SimHash of lower-cased word shingles; every occurrence counts; a text without words gives 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_in_shingle:
        return int(xxhash.xxh64_intdigest(joined, seed))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, total = np.zeros(64, np.int64), len(words) - words_in_shingle + 1
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    a, z = starts[:total].tolist(), ends[words_in_shingle - 1 :].tolist()
    for at in range(0, total, 65536):
        h = np.array([digest(view[i:j], seed) for i, j in zip(a[at : at + 65536], z[at : at + 65536], strict=True)], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * count > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(<id_col>, fp long)``; ``fp`` is the fingerprint's 64 bits as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["_id", "fp"])

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(tidy(run), f"_id {kind}, fp long")
    return got.withColumnRenamed("_id", id_col)


# ---- anchors ----


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words on division by the generator, bit by bit from the top."""
    w = words.astype(np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ (GENERATOR << (bit - 11)), w)
    return w


@lru_cache(maxsize=4)
def errors(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to ``RADIUS + excess`` by syndrome: starts into (patterns, excess of each)."""
    found, over = [], []
    for weight in range(RADIUS + excess + 1):
        found.append(np.array([sum(1 << k for k in bits) for bits in combinations(range(23), weight)], np.int64))
        over.append(np.full(len(found[-1]), max(0, weight - RADIUS)))
    patterns, over = np.concatenate(found), np.concatenate(over)
    s = syndromes(patterns)
    order = np.lexsort((over, s))
    starts = np.searchsorted(s[order], np.arange(2049))
    return starts, patterns[order], over[order]


def anchors_of(block: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block word the code words within ``RADIUS + excess``: (row, code word, excess); excess 0 is the home."""
    starts, patterns, over = errors(excess)
    s = syndromes(block)
    n = starts[s + 1] - starts[s]
    row = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
    return row, block[row] ^ patterns[at], over[at]


def placements(fp: np.ndarray, pairs: bool, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each fingerprint is compared: (row, anchor, at home there).

    Of ``threshold`` differing bits at most a third fall into some block, and at
    most two thirds into some pair of blocks.
    """
    u = fp.view(np.uint64)
    parts = [((u >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in BLOCKS]
    rows, keys, homes = [], [], []
    if not pairs:
        for k, part in enumerate(parts):
            row, code, over = anchors_of(part, threshold // 3)
            rows.append(row)
            keys.append(code | k << 48)
            homes.append(over == 0)
    else:
        most = 2 * threshold // 3
        for k, (i, j) in enumerate(combinations(range(3), 2)):
            row, code, over = anchors_of(parts[i], most)
            row2, code2, over2 = anchors_of(parts[j][row], most)
            keep = over[row2] + over2 <= most
            rows.append(row[row2][keep])
            keys.append((code[row2] << 23 | code2 | k << 48)[keep])
            homes.append((over[row2] + over2 == 0)[keep])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def forest(left: np.ndarray, right: np.ndarray, threshold: int, step: int = 1 << 22) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of fingerprints."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    rows = max(1, step // max(1, len(right)))
    a, b = left.view(np.uint64), right.view(np.uint64)
    for at in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= threshold)
        for x, y in zip(left[at + i].tolist(), right[j].tolist(), strict=True):
            if x != y and (p := find(x)) != (q := find(y)):
                parent[p] = q
                out.append((x, y))
    return out


def _compare(group):
    """Groups arrive ordered by (anchor, cut); ``group`` gets a group's columns and gives a batch or None."""

    def run(batches):
        key, rest = None, []
        for b in batches:
            k = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(2, b.num_columns)]
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if key != (now := tuple(k[x].tolist())):
                    if rest and (out := group(*map(np.concatenate, zip(*rest, strict=True)))) is not None:
                        yield out
                    key, rest = now, []
                rest.append([c[x:y] for c in cols])
        if rest and (out := group(*map(np.concatenate, zip(*rest, strict=True)))) is not None:
            yield out

    return run


def _met(points: DataFrame, threshold: int, pairs: bool, hot: int) -> DataFrame:
    """``(anchor, cut, side, fp, ...)``: the rows of ``points`` (``fp`` and others) at every anchor they are compared at, in order.

    ``side`` has 1 for what is at home there and 2 for what it is compared with; a
    hot anchor's rows are dealt to cuts, each a block of homes with a block of all.
    """
    names = points.columns
    step = 2048 if pairs else 16384
    spark = points.sparkSession

    def place(batches):
        for b in batches:
            fp = np.ascontiguousarray(b.column("fp").to_numpy())
            for at in range(0, len(fp), step):
                row, key, home = placements(fp[at : at + step], pairs, threshold)
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(home, 3, 2).astype(np.int32)), *[c.take(take) for c in b.columns]], ["anchor", "side", *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    placed = points.mapInArrow(tidy(place), f"anchor long, side int, {fields}")
    dealt = _dealt(placed, names, F.count(F.lit(1)), hot)
    return dealt.repartition(partitions(spark), "anchor", "cut").sortWithinPartitions("anchor", "cut")


def _dealt(placed: DataFrame, names: list[str], weight: Column, hot: int) -> DataFrame:
    """``(anchor, cut, side, *names)`` of ``(anchor, side, *names)``: anchors of more than ``hot`` weight in cuts."""
    sizes = placed.groupBy("anchor").agg(weight.alias("n")).filter(F.col("n") > hot)
    sizes = materialize(sizes.select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("k")), "hot")
    placed = placed.withColumn("cut", F.lit(0))
    if not sizes.isEmpty():
        # k blocks of homes times k blocks of all: a row's side 1 is compared with side 2
        wide = placed.join(sizes, "anchor", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        mine = F.pmod(F.xxhash64(*names), F.col("k")).cast("int")
        every = F.sequence(F.lit(0), F.col("k") - 1)
        as_home = F.when(F.col("side") == 3, F.transform(every, lambda x: F.struct((mine * F.col("k") + x).alias("cut"), F.lit(1).alias("side"))))
        as_all = F.transform(every, lambda x: F.struct((x * F.col("k") + mine).alias("cut"), F.lit(2).alias("side")))
        parts = F.explode(F.concat(F.coalesce(as_home, F.array().cast("array<struct<cut:int,side:int>>")), as_all))
        placed = wide.select("anchor", *names, parts.alias("p")).select("anchor", *names, F.col("p.side").alias("side"), F.col("p.cut").alias("cut"))
    return placed.select("anchor", "cut", "side", *names)


def links(points: DataFrame, threshold: int = THRESHOLD, hot: int = HOT, many: int = MANY) -> DataFrame:
    """Edges ``(a, b)`` that connect just what links of at most ``threshold`` (4 or less) bits connect, over distinct ``fp``."""
    if threshold > THRESHOLD:
        raise ValueError("the anchors cover at most 4 differing bits")
    pairs = points.count() > many

    def group(side, fp):
        if len(fp) < 2:
            return None
        edges = forest(np.ascontiguousarray(fp[side & 1 > 0]), np.ascontiguousarray(fp[side & 2 > 0]), threshold)
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"]) if edges else None

    return _met(points.select("fp"), threshold, pairs, hot).mapInArrow(tidy(_compare(group)), "a long, b long")


# ---- similarity of shingles ----

WIDE_THRESHOLD = 8
FIRST_NEAREST = 4
PARITY_BITS = 64, 4096  # fewest and most; sets of more than 5461 shingles are ruled out by less
ROOM = 400  # shingles compared at once for each fingerprint that is


def word_fingerprint(words: list[bytes]) -> int:
    """SimHash of the set of words."""
    if not words:
        return 0
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(words)], np.uint64)
    bits = 2 * np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of the word shingles; of the whole sequence where it is shorter; of no words, none."""
    n = max(1, len(words) - size + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 1) for k in range(n)], np.uint64)).view(np.int64)


def parities(s: np.ndarray) -> bytes:
    """Parities of the numbers of hashes that share their last bits; a power of two of them, 0.75 for each hash at least.

    Two sets differ in no fewer members than their parities do; half as many
    parities are the halves' exclusive or.
    """
    low, high = PARITY_BITS
    size = low
    while size < high and size < 0.75 * len(s):
        size *= 2
    odd = np.bincount((s.view(np.uint64) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(par: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """In how many parities ``par[r]`` and ``par[c]`` differ, the longer one folded."""
    width = np.array([len(x) for x in par])
    least, out = np.minimum(width[r], width[c]), np.zeros(len(r), np.int64)
    for w in np.unique(least).tolist():
        pick = np.flatnonzero(least == w)
        used = np.unique(np.concatenate([r[pick], c[pick]]))
        place = np.zeros(len(par), np.int64)
        place[used] = np.arange(len(used))
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, w // 8), 0) for x in par[used]])
        step = max(1, (1 << 22) // w)
        for at in range(0, len(pick), step):
            p = pick[at : at + step]
            out[p] = np.bitwise_count(bits[place[r[p]]] ^ bits[place[c[p]]]).sum(1)
    return out


def _likely(threshold: int, similarity: float, side, fp, n, comp, par):
    """For blocks of a group's homes, which pairs (home, other) of two components fingerprints, numbers of shingles and
    parities allow to be similar, and by how many bits these differ: yields (home rows, other rows, parities, bits)."""
    home, every = np.flatnonzero(side & 1 > 0), np.flatnonzero(side & 2 > 0)
    if not len(home) or not len(every):
        return
    u = fp.view(np.uint64)
    share = (1 - similarity) / (1 + similarity)  # of both sets' sizes, the most that similar ones differ in
    rows = max(1, (1 << 22) // len(every))
    for at in range(0, len(home), rows):
        h = home[at : at + rows]
        d = np.bitwise_count(u[h][:, None] ^ u[every][None, :])
        r, c = np.nonzero(d <= threshold)
        d, r, c = d[r, c], h[r], every[c]
        fits = (comp[r] != comp[c]) & (np.minimum(n[r], n[c]) >= similarity * np.maximum(n[r], n[c]) - 1e-9)
        r, c, d = r[fits], c[fits], d[fits]
        odd = differing(par, r, c) if len(r) else d
        fits = odd <= share * (n[r] + n[c]) + 1e-6
        if fits.any():
            yield r[fits], c[fits], odd[fits] / (n[r] + n[c])[fits], d[fits]


def _nearest(threshold: int, similarity: float, most: int):
    """Of a group's homes the ``most`` likeliest others, as pairs; of homes that have more, who meets there (3 at home, 2
    others), as rows ``(null, null, anchor, node, side)``."""

    def group(anchor, side, fp, node, n, par):
        found, mark = [], np.zeros(len(fp), np.int32)
        for r, c, odd, d in _likely(threshold, similarity, side, fp, n, node, par):
            order = np.lexsort((node[c], d, odd, r))
            r, c = r[order], c[order]
            start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            count = np.diff(np.append(start, len(r)))
            near = np.arange(len(r)) - np.repeat(start, count) < most
            more = np.repeat(count, count) > most
            mark[r[more]] |= 3
            mark[c[more]] |= 2
            found.append((node[r[near]], node[c[near]]))
        if not found:
            return None
        a, b = map(np.concatenate, zip(*found, strict=True))
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        own = np.flatnonzero(mark)
        none = lambda k, t: pa.nulls(k, t)
        pairs = [pa.array(a), pa.array(b), none(len(a), pa.int64()), none(len(a), pa.int64()), none(len(a), pa.int32())]
        meets = [none(len(own), pa.int64()), none(len(own), pa.int64()), pa.array(anchor[own]), pa.array(node[own]), pa.array(mark[own])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(pairs, meets, strict=True)], ["a", "b", "anchor", "node", "side"])

    return group


def _concerned(threshold: int, similarity: float):
    """A group's homes with likely others, and these: who must be compared in shingles."""

    def group(anchor, side, fp, node, n, comp, par):
        mark = np.zeros(len(fp), np.int32)
        for r, c, _, _ in _likely(threshold, similarity, side, fp, n, comp, par):
            mark[r] |= 3
            mark[c] |= 2
        own = np.flatnonzero(mark)
        if not len(own):
            return None
        return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (anchor, mark, fp, node, n, comp)], ["anchor", "side", "fp", "node", "n", "comp"])

    return group


def _alike(threshold: int, similarity: float):
    """A spanning forest, over components, of the links among a group's homes and others, by all their shingles."""

    def group(side, fp, node, n, comp, s):
        home, every = np.flatnonzero(side & 1 > 0), np.flatnonzero(side & 2 > 0)
        if not len(home) or not len(every):
            return None
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        values = np.concatenate([np.asarray(s[k]) for k in every])
        owner = np.repeat(np.arange(len(every)), [len(s[k]) for k in every])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        u, edges = fp.view(np.uint64), []
        for h in home.tolist():
            own = np.asarray(s[h])
            a, z = np.searchsorted(values, own), np.searchsorted(values, own, "right")
            length = z - a
            at = np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())
            m = np.bincount(owner[at], minlength=len(every))
            linked = (m >= similarity * (n[h] + n[every] - m) - 1e-9) & (np.bitwise_count(u[h] ^ u[every]) <= threshold) & (comp[every] != comp[h])
            for k in every[linked].tolist():
                if (p := find(int(comp[h]))) != (q := find(int(comp[k]))):
                    parent[p] = q
                    edges.append((int(node[h]), int(node[k])))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"]) if edges else None

    return group


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, threshold: int = WIDE_THRESHOLD, hot: int = HOT,
    nearest: int = FIRST_NEAREST,
) -> DataFrame:
    """``(<id_col>, component_id)``, a row for a row: documents are linked if the Jaccard similarity of their sets of word
    shingles is at least ``similarity`` and the fingerprints of their sets of words differ in at most ``threshold`` bits.

    ``component_id`` is the least row key that links reach (the id itself, where
    ids are integers without null or repeats).  A-Z count as a-z.  Equal word
    sequences are one node, so copies are never compared.  A node is first
    compared in shingles with its ``nearest`` likeliest candidates of each block,
    as rows.  Nodes that have more of them, outside their component by then, meet these with
    all their shingles at the anchors, where only a forest of links is emitted:
    rows grow with the nodes, not with the pairs of a group, and no link is lost.  Null, empty and wordless texts
    are one node; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")), "_id", "_t")

    def sketch(batches):
        for b in sliced(batches):
            out = []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().lower().split()
                raw = xxhash.xxh3_128_digest(b" ".join(words))
                own = shingles(words, size)
                out.append((int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True), word_fingerprint(words), len(own), parities(own)))
            d1, d2, fp, n, par = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(par, pa.binary())],
                ["rk", "d1", "d2", "fp", "n", "par"],
            )

    prints = materialize(rows.select("rk", "_t").mapInArrow(tidy(sketch), "rk long, d1 long, d2 long, fp long, n long, par binary"), "prints")
    firsts = prints.groupBy("d1", "d2").agg(F.min("rk").alias("node"))
    nodes = materialize(firsts.join(prints.select(F.col("rk").alias("node"), "fp", "n", "par"), "node"), "nodes")
    points = nodes.filter("n > 0").select("fp", "node", "n", "par")

    def cut(batches):
        for b in batches:
            sets = [shingles((t or "").encode().lower().split(), size) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], ["node", "s"])

    def sets_of(some: DataFrame) -> DataFrame:
        texts = rows.select(F.col("rk").alias("node"), "_t").join(some.select("node").distinct(), "node", "left_semi")
        return materialize(texts.mapInArrow(tidy(cut), "node long, s array<long>"), "sets")

    # the likeliest candidates
    met = _met(points, threshold, False, hot).select("anchor", "cut", F.col("anchor").alias("at"), "side", *points.columns)
    found = met.mapInArrow(tidy(_compare(_nearest(threshold, similarity, nearest))), "a long, b long, anchor long, node long, side int")
    found = materialize(found, "found")
    tried = materialize(found.filter("a is not null").select("a", "b").distinct(), "candidates")
    left = materialize(found.filter("a is null").groupBy("anchor", "node").agg(F.max("side").alias("side")), "left")
    sets = sets_of(tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))))
    both = tried.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    linked = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), same.alias("m")).filter(F.col("m") >= similarity * (F.col("nx") + F.col("ny") - F.col("m")) - 1e-9)
    linked = materialize(linked.select("a", "b"), "links")
    for table in (found, tried, sets):
        forget(spark, table)
    roots = None if linked.isEmpty() else materialize(components(linked, "a", "b"), "roots")

    # and all that are left, where some of another component are
    if not left.isEmpty():
        if roots is not None:
            left = left.join(roots, "node", "left").select("anchor", "node", "side", F.coalesce("root", "node").alias("comp"))
        else:
            left = left.withColumn("comp", F.col("node"))
        mixed = left.groupBy("anchor").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("anchor")
        names = ["fp", "node", "n", "comp", "par"]
        left = left.join(mixed, "anchor", "left_semi").join(points, "node").select("anchor", "side", *names)
        met = _dealt(materialize(left, "mixed"), names, F.count(F.lit(1)), hot).select("anchor", "cut", F.col("anchor").alias("at"), "side", *names)
        met = met.repartition(partitions(spark), "anchor", "cut").sortWithinPartitions("anchor", "cut")
        some = met.mapInArrow(tidy(_compare(_concerned(threshold, similarity))), "anchor long, side int, fp long, node long, n long, comp long")
        some = materialize(some.groupBy("anchor", "node", "fp", "n", "comp").agg(F.max("side").alias("side")), "concerned")
        if not some.isEmpty():
            sets = sets_of(some)
            names = ["fp", "node", "n", "comp"]
            dealt = _dealt(some.select("anchor", "side", *names), names, F.sum("n"), hot * ROOM).join(sets, "node").select("anchor", "cut", "side", *names, "s")
            more = dealt.repartition(partitions(spark), "anchor", "cut").sortWithinPartitions("anchor", "cut").mapInArrow(tidy(_compare(_alike(threshold, similarity))), "a long, b long")
            linked = materialize(linked.unionByName(more), "links")
            forget(spark, sets)
            roots = None if linked.isEmpty() else materialize(components(linked, "a", "b"), "roots")
    of = nodes.select("d1", "d2", "node")
    if roots is not None:
        of = of.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component_id"))
    else:
        of = of.withColumnRenamed("node", "component_id")
    of = prints.join(materialize(of, "of"), ["d1", "d2"]).select("rk", "component_id")
    return rows.select("rk", "_id").join(of, "rk").select(F.col("_id").alias(id_col), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(<id_col>, fp long, component_id)``, a row for a row.

    Documents whose fingerprints differ in at most ``threshold`` bits are linked;
    ``component_id`` is the least id that links reach (null ids don't count, and
    a component of null ids only has a null one).  Null, empty and wordless texts
    have fingerprint 0 and are linked like any other.  Repeated rows share a
    component.  An empty table gives an empty result; other columns are ignored.
    """
    apart(id_col, "fp", "component_id")
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    points = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "points")
    edges = materialize(links(points, threshold), "links")
    roots = components(edges, "a", "b")
    roots = materialize(roots, "roots")
    linked = roots.join(points, roots["node"] == points["fp"]).groupBy("root").agg(F.min("least").alias("c"))
    named = roots.join(linked, "root").select(F.col("node").alias("fp"), "c")
    of = materialize(points.join(named, "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id")), "of")
    # settled, so that this join has an exchange on either side and a fingerprint of very many rows can be split
    return prints.join(of, "fp").select(id_col, "fp", "component_id")
